"""Headers of tables of names, written with blanks, _ and -."""

from inkveil.operators import names

from .test_rules import values


def test_spaced_headers(spark):
    """Every known column, with each thing that its key leaves out after each of the first three letters."""
    for columns, cell, detect in ((names.ORGANIZATION_COLUMNS, "Oak Street Supplies", names.organization_names), (names.PERSON_COLUMNS, "Ada Quill", names.person_names)):
        headers = [c[:n] + mark + c[n:] for c in columns for n in (1, 2, 3) for mark in " _-"] + ["Org Name", "Org-Name", "Org_Name", "OrgName"] * (detect is names.organization_names)
        # the first cell of the line, and the last
        texts = [t for h in headers for t in (f"{h},Count\n{cell},3", f"Count,{h}\n3,{cell}")]
        assert values(spark, texts, detect) == [[cell]] * len(texts)
