"""Author initials in texts of several lines: what the first line is must not decide for the rest."""

from inkveil.operators.scan import ScanOptions, scan


def test_initials_on_any_line(spark):
    texts = [
        "param($x)\nSet-Thing AB\n# Modified 2021 by JQ\r\n$y = 'CD'\n  # rev 3 EF, SQL\n", "# Modified 2021 by JQ\nno comment GH", "x # Author KL",
        "a\r# Author MN\rOP", "# see QR History", "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = scan(rows, options=ScanOptions(frozenset(["author-initials"]))).select("doc_id", "findings").collect()
    got = {r.doc_id: [f.value for f in r.findings] for r in found}
    assert got == {0: ["JQ", "EF"], 1: ["JQ"], 2: [], 3: ["MN"], 4: ["QR"], 5: [], 6: []}
    assert all(texts[r.doc_id][f.start : f.end] == f.value for r in found for f in r.findings)
