"""Names of people and organizations, as native expressions: labelled fields, comment bylines, cues in prose, titles, signatures,
quoted names on lines about names, names that match an email of the same text, copyright lines, legal suffixes, and columns of
comma-separated tables. All but the matched emails are of low confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import LOW, MEDIUM, SPAN, Pattern, as_spans, fold, jvm, let, matches, no_spans

# Fixed values.
FULL_NAME_LABELS = (
    r"full[ _-]?name|display[ _-]?name|owner|requested[ _-]?by|manager|approver|contact|author|created[ _-]?by|prepared[ _-]?by|modified[ _-]?by|requester|requestor|"
    r"reviewer|submitter|recipient|attn|attention|assigned[ _-]?to|technician|supervisor|employee(?:[ _-]?name)?|patient(?:[ _-]?name)?|user|to|from|cc|bcc"
)
SINGLE_NAME_LABELS = r"name|first[ _-]?name|given[ _-]?name|last[ _-]?name|family[ _-]?name|surname"
ORGANIZATION_LABELS = (
    r"company[ _-]?name|company|organi[sz]ation|org[ _-]?name|tenant[ _-]?name|employer|department|business[ _-]?unit|agency|client|site|facility|hospital|school|vendor|"
    r"customer|partner|supplier|institution|division|practice|firm"
)
PARTICLES = "al|bin|da|das|de|del|della|den|der|di|dos|du|el|ibn|la|le|te|ten|ter|van|von"
COMMAND_VERBS = (
    "Add|Clear|Close|Compare|Convert|ConvertFrom|ConvertTo|Copy|Disable|Dismount|Enable|Enter|Exit|Expand|Export|Find|Format|Get|Import|Install|Invoke|Join|Measure|Mount|"
    "Move|New|Out|Push|Pop|Read|Register|Remove|Rename|Reset|Resize|Resolve|Restart|Restore|Resume|Select|Send|Set|Show|Sort|Split|Start|Stop|Suspend|Test|Unblock|"
    "Uninstall|Unregister|Update|Wait|Write"
)
STOP_WORDS = (
    "a", "an", "the", "this", "that", "these", "those", "my", "our", "your", "his", "her", "their", "its", "me", "us", "him", "them", "we", "you", "it", "he", "she", "they", "i",
    "if", "when", "then", "all", "any", "each", "every", "some", "no", "not", "please", "and", "or", "but", "for", "with", "at", "on", "in", "to", "from", "by", "of", "as", "is",
    "are", "was", "were", "be", "being", "been", "will", "shall", "should", "would", "can", "could", "may", "might", "must", "do", "does", "did", "here", "there", "now", "today",
    "support", "team", "help", "desk", "admin",
)
CUES = (
    r"contact(?:ed)?|as[ \t]+per|c/o|"
    r"(?:prepared|written|created|authored|reviewed|approved|submitted|requested|signed|provided|sent|pulled|lifted|copied|received|forwarded|maintained|reported|owned)[ \t]+(?:by|from)|"
    r"reviewed[ \t]+with|(?:prepared|created|written|reviewed|approved|submitted|signed)[ \t]+for[ \t][^\r\n]{0,80}?[ \t]by|"
    r"(?:escalated|assigned|handed[ \t]+off|transferred|routed)[ \t]+to|(?:spoke|met|meeting|call|conversation)[ \t]+with|on[ \t]+behalf[ \t]+of|"
    r"(?:kind[ \t]+|warm[ \t]+|best[ \t]+|many[ \t]+)?(?:regards|thanks|thank[ \t]+you|sincerely|cheers)[ \t]*,"
)
#: Every cue has one of these, and every closing one of the next.
CUE_WORDS = (
    "contact", "per", "c/o", "prepared", "written", "created", "authored", "reviewed", "approved", "submitted", "requested", "signed", "provided", "sent", "pulled", "lifted", "copied",
    "received", "forwarded", "maintained", "reported", "owned", "escalated", "assigned", "handed", "transferred", "routed", "spoke", "met", "meeting", "call", "conversation", "behalf",
    "regards", "thank", "sincerely", "cheers",
)
CLOSING_WORDS = ("regards", "thank", "sincerely", "cheers", "respectfully")
CLOSINGS = r"kind[ \t]+regards|warm[ \t]+regards|best[ \t]+regards|many[ \t]+thanks|regards|thanks|thank[ \t]+you|sincerely|cheers|respectfully"
TITLES = "Dr|Mr|Mrs|Ms|Mx|Prof|Professor|Rev"
BROAD_SUFFIXES = (
    "Health|Healthcare|Hospital|University|College|School|Services|Systems|Solutions|Department|Team|Foundation|Association|Agency|Ministry|Council|Institute|Centre|Center|"
    "Clinic|Network|Group|Company|Corporation|Corp|Inc|Ltd|LLC"
)
STRONG_SUFFIXES = "Hospital|Healthcare|Ltd|LLC|Inc|Corp|Corporation|Incorporated|University|College|Clinic|Foundation|Institute"
NO_ORGANIZATION = ("TBD", "TBA", "TODO", "N/A", "NA", "NONE", "NULL", "TRUE", "FALSE", "UNKNOWN", "PENDING", "DEFAULT")
TECHNICAL_WORDS = ("admin", "build", "contact", "desk", "help", "info", "release", "service", "support", "system", "team", "test", "version")
PERSON_COLUMNS = (
    "name", "fullname", "displayname", "firstname", "givenname", "lastname", "familyname", "surname", "preferredname", "owner", "manager", "supervisor", "contact", "contactname",
    "requestedby", "approver", "approvedby", "author", "createdby", "preparedby", "modifiedby", "employeename", "patientname",
)
ORGANIZATION_COLUMNS = (
    "company", "companyname", "organization", "organisation", "orgname", "tenantname", "employer", "department", "businessunit", "agency", "client", "clientname", "site", "facility",
    "hospital", "school", "vendor", "vendorname",
)

_IN = r"[\p{L}\p{M}'’.-]"
#: A capitalised part of a name has a small letter too.
PART = rf"\p{{Lu}}(?={_IN}*\p{{Ll}}){_IN}*"
INITIAL, SUFFIX = r"\p{Lu}\.?", r"(?:Jr|Sr|II|III|IV)\.?"
#: A part that punctuation may follow.
_TOKEN = rf"\p{{Lu}}(?={_IN}*\p{{Ll}}){_IN}*[\p{{L}}\p{{M}}](?![\p{{L}}\p{{M}}\p{{N}}_@/\\-])"
_STOP = rf"(?!(?i:{'|'.join(STOP_WORDS)})(?![\p{{L}}\p{{N}}]))(?!(?:{COMMAND_VERBS})-\p{{Lu}})"
_NEXT = rf"[ \t]+{_STOP}(?:{_TOKEN}|(?:{PARTICLES})(?=[ \t])|\p{{Lu}}\.|\p{{Lu}}(?![\p{{L}}\p{{N}}])|(?:Jr|Sr)\.|(?:Jr|Sr|II|III|IV)(?![\p{{L}}\p{{N}}]))"
WALK = rf"{_STOP}{_TOKEN}(?:{_NEXT}){{%d,4}}"

ORGANIZATION_WORD = r"(?:\p{Lu}|[0-9])[\p{L}\p{M}0-9&.'’/–—-]*"
CONNECTOR = r"(?i:&|and|of|the|de|la)"
_BARE = r"(?:\p{Lu}|[0-9])[\p{L}\p{M}0-9&.'’/–—-]*[\p{L}\p{M}0-9&/–—-]|\p{Lu}"

BYLINE = r"(?im)^[ \t]*#[^\r\n]*?\b(?:author|created[ \t]+by|prepared[ \t]+by|written[ \t]+by|maintainer|contact)\b[ \t]*[:=-]?[ \t]+([^\r\n,;#]+?)[ \t]*(?=[ \t](?:for|at|with|on|from|if|when|about|regarding|via|to)[ \t]|[\r\n,;#]|\z)"
PROSE = rf"(?i:\b(?:{CUES}))[ \t]+({WALK % 1})"
TITLED = rf"\b(?:{TITLES})\.?[ \t]+({WALK % 0})"
SIGNATURE = rf"(?im)^[ \t]*(?:{CLOSINGS})[ \t]*[,.!]?[ \t]*(?:\r\n|\n|\r)[ \t]*([^\r\n]*[^\s])"
NAME_LINE = r"(?i)\b(?:name|names|person|people|contact|owner|manager|author)\b"
QUOTED = r""""[ \t]*([^"\r\n]*[^"\s])[ \t]*"|'[ \t]*([^'\r\n]*[^'\s])[ \t]*'"""
EMAIL_LOCAL = r"\b([A-Za-z][A-Za-z0-9._'-]{2,63})@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,61}[A-Za-z0-9])?\.[A-Za-z]{2,}\b"
PAIR = r"(?<![\p{L}\p{N}_])\p{Lu}[\p{Ll}\p{M}'’.-]+[ \t]+\p{Lu}[\p{Ll}\p{M}'’.-]*[\p{Ll}\p{M}](?![\p{L}\p{N}_])"
COMMENT_ORGANIZATION = (
    r"(?im)^[ \t]*#[^\r\n]*?\b(?:for|at|client(?:[ \t]+is)?|company(?:[ \t]+is)?|organi[sz]ation(?:[ \t]+is)?)[ \t]*[:=-]?[ \t]+(?:the[ \t]+)?"
    rf"((?:(?!(?:{BROAD_SUFFIXES})(?![\p{{L}}\p{{N}}]))[^\s,;#]+[ \t]+){{0,6}}(?:{BROAD_SUFFIXES})(?![\p{{L}}\p{{N}}])(?:[ \t]+(?!(?:by|from|with|using|on)[ \t])[^\s,;#]+){{0,2}})"
)
COPYRIGHT = (
    r"(?i:\bcopyright\b)[ \t]*(?:\([cC]\)|©)?[ \t]*(?:19|20)\d{2}(?:[ \t]*[-–,][ \t]*(?:19|20)\d{2})*[ \t]+(?i:by[ \t]+)?"
    rf"({ORGANIZATION_WORD}(?:[ \t]+(?!(?i:all[ \t]+rights))(?:{ORGANIZATION_WORD}|{CONNECTOR}(?=[ \t]))){{0,7}})"
)
SUFFIXED = (
    rf"(?<![^\s(\[\"'])(?!{CONNECTOR}[ \t])(?!\d+[ \t])((?:(?!\d+[ \t])(?:{_BARE})[ \t]+(?:{CONNECTOR}[ \t]+)*){{1,7}}(?:{STRONG_SUFFIXES})"
    rf"(?:[ \t]+(?:{BROAD_SUFFIXES}))*)(?![\p{{L}}\p{{N}}])"
)


def _parts(value: Column) -> Column:
    return F.size(F.split(value, r"[ \t]+"))


def looks_like_name(value: Column, single: bool) -> Column:
    shape = rf"^(?:{PART}|(?:{PARTICLES}))(?:[ \t]+(?:{PART}|(?:{PARTICLES})|{INITIAL}))*(?:[ \t]+{SUFFIX})?\z"
    command = rf"(?:^|[ \t])(?:{COMMAND_VERBS})-\p{{Lu}}[\p{{L}}\p{{Nd}}]*(?:[ \t]|\z)"
    return _parts(value).between(1 if single else 2, 5) & value.rlike(shape) & ~value.rlike(command)


def is_caseless(value: Column) -> Column:
    """Of a script without capitals."""
    return ~value.rlike(r"[\p{Lu}\p{Ll}]") & value.rlike(r"^[\p{L}\p{M}][\p{L}\p{M}\p{Nd}・'’. -]{0,39}\z")


def looks_like_organization(value: Column) -> Column:
    words = F.split(F.regexp_replace(value, r"\.\z", ""), r"[ \t]+")
    is_word = lambda w: w.rlike(rf"^{ORGANIZATION_WORD}\z")
    fits = F.exists(words, is_word) & F.forall(words, lambda w: is_word(w) | w.rlike(rf"^{CONNECTOR}\z"))
    return (F.size(words) <= 8) & value.rlike(r"\p{L}") & ~((F.size(words) == 1) & F.get(words, F.lit(0)).isin(*NO_ORGANIZATION)) & fits


def _shaped(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A confidence: low where the value has the shape."""
    return lambda v: F.when(test(v), F.lit(LOW))


def _full(v: Column) -> Column:
    return looks_like_name(v, False)


def _person(v: Column) -> Column:
    return looks_like_name(v, True) | is_caseless(v)


def _organization(v: Column) -> Column:
    return looks_like_organization(v) | is_caseless(v)


def _field_end(v: Column) -> Column:
    """A field's value without the next field of its line and blanks at the end."""
    return F.regexp_replace(v, r"[ \t]{2,}[A-Za-z][A-Za-z0-9 _-]{0,30}[ \t]*[:=].*|\s+\z", "")


def _undotted(v: Column) -> Column:
    return F.regexp_replace(v, r"\.\z", "")


def labelled(labels: str, test: Callable[[Column], Column], cut: Callable[[Column], Column] = _field_end) -> Pattern:
    """Values after a bare or quoted label and : or =, up to the line's end, a separator, or the next field."""
    pattern = rf"""(?:"(?i:{labels})"|'(?i:{labels})'|\b(?i:{labels})\b)[ \t]*[:=][ \t]*(?:"[ \t]*([^"\r\n]+)"|'[ \t]*([^'\r\n]+)'|([^,;\r\n#]+))"""
    return Pattern(pattern, (1, 2, 3), _shaped(lambda v: ~v.rlike(r"^[$\[(<*]") & test(v)), gate="[:=]", cut=lambda m: cut(m["value"]), lines=True)


def email_matched(text: Column) -> Column:
    """Pairs of capitalised words that are first and last name, or initial and last name, of an email's local part."""
    words = lambda m: F.split(F.lower(m["value"]), r"[ \t]+")

    def key(v: Column) -> Column:
        joined = F.regexp_replace(v, "[._-]", " ")
        initial = F.concat(F.left(v, F.lit(1)), F.lit(" "), F.substring(v, F.lit(2), F.lit(64)))
        return F.when(v.rlike(r"^[a-z]{2,}[._-][a-z]{2,}\z"), joined).when(v.rlike(r"^[a-z]{3,}\z"), initial)

    def matched(m: Column, keys: Column) -> Column:
        first, last = F.get(words(m), F.lit(0)), F.get(words(m), F.lit(1))
        known = F.array_contains(keys, F.concat_ws(" ", first, last)) | F.array_contains(keys, F.concat_ws(" ", F.left(first, F.lit(1)), last))
        own = F.coalesce(known, F.lit(False)) & ~first.isin(*TECHNICAL_WORDS) & ~last.isin(*TECHNICAL_WORDS)
        return own & looks_like_name(m["value"], False) & ~m["before"].rlike(r"@[A-Za-z0-9.-]*\z")

    # A pair that runs into an address is a part of it.
    pairs = matches(text, [Pattern(rf"{PAIR}(?![A-Za-z0-9._'-]*@[A-Za-z0-9])", confidence=MEDIUM, context=True)])
    keys = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(jvm(EMAIL_LOCAL)), F.lit(1)), lambda v: key(F.lower(v))))
    found = let(keys, lambda k: F.when(F.size(k) > 0, as_spans(F.filter(pairs, lambda m: matched(m, k)))))
    return F.coalesce(F.when(text.contains("@"), found), no_spans())


def table_cells(text: Column, columns: tuple[str, ...], test: Callable[[Column], Column]) -> Column:
    """Cells under the known columns of a header line, for the lines after it up to a blank one, one that isn't well formed, or one
    of another number of cells. Of a quoted cell the inside; doubled quotes count as one for the test."""
    cell = r""",("[^"]*+(?:""[^"]*+)*+"(?=,|\z)|(?!")[^,]*+)"""
    known = F.array(*map(F.lit, (*PERSON_COLUMNS, *ORGANIZATION_COLUMNS)))
    empty = F.array().cast("array<string>")
    quoted = lambda c: c.startswith('"')
    inner = lambda c: F.when(quoted(c), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(F.trim(c))

    def spans_of(cells: Column, keys: Column, at: Column) -> Column:
        def place(acc: Column, c: Column) -> Column:
            lead = F.when(quoted(c), F.lit(1)).otherwise(F.length(c) - F.length(F.ltrim(c)))
            start, value = acc["at"] + lead, inner(c)
            plain = F.trim(F.replace(value, F.lit('""'), F.lit('"')))
            fits = F.get(keys, acc["i"]).isin(*columns) & (F.length(plain) > 0) & test(plain)
            span = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.lit(LOW).alias("confidence"))
            return F.struct((acc["at"] + F.length(c) + 1).alias("at"), (acc["i"] + 1).alias("i"), F.when(fits, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(cells, F.struct(at.alias("at"), F.lit(0).alias("i"), no_spans().alias("out")), place)["out"]

    def read(raw: Column) -> Column:
        line = F.regexp_replace(raw, r"[\r\n]+\z", "")
        found = F.when(line.contains(","), F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(cell), F.lit(1)))
        whole = F.aggregate(found, F.lit(-1), lambda n, c: n + F.length(c) + 1) == F.length(line)
        return F.struct(F.when(whole, found).otherwise(empty).alias("cells"), F.length(raw).alias("n"))

    def step(done: Column, x: Column) -> tuple[dict[str, Column], Column]:
        cells = x["cells"]
        keys = F.transform(cells, lambda c: F.lower(F.regexp_replace(F.trim(inner(c)), "[ _-]", "")))
        row = (F.size(done["columns"]) > 0) & (F.size(cells) == F.size(done["columns"]))
        header = (F.size(cells) >= 2) & F.forall(cells, lambda c: F.trim(inner(c)).rlike(r"^[A-Za-z][A-Za-z0-9 _-]{0,39}\z")) & F.arrays_overlap(keys, known)
        kept = F.when(row, done["columns"]).when(header, keys).otherwise(empty)
        return {"at": done["at"] + x["n"], "columns": kept}, F.when(row, spans_of(cells, done["columns"], done["at"])).otherwise(no_spans())

    lines = F.transform(F.regexp_extract_all(text, F.lit(r"[^\r\n]*+(?:\r\n|\n|\r|\z)"), F.lit(0)), read)
    folded = fold(lines, {"at": F.lit(0), "columns": empty}, step, SPAN)["out"]
    # A line of nothing but what headers are made of, with a comma: only then can there be a header.
    header_like = r"""(?<![^\r\n])[A-Za-z0-9 _"\t-]*+,[A-Za-z0-9 _",\t-]*+(?=[\r\n]|\z)"""
    return F.coalesce(F.when(text.contains(",") & text.rlike(header_like), folded), no_spans())


#: A line that speaks of names; parameters like -Name don't count.
ABOUT_NAMES = Pattern(
    rf"(?<![^\n])[^\n]*(?:{NAME_LINE})[^\n]*", gate=("name", "person", "people", "contact", "owner", "manager", "author"), lines=True,
    test=lambda m: F.regexp_replace(m["value"], r"(?:^|[ \t])-\w+", " ").rlike(jvm(NAME_LINE)),
)
PERSON_PATTERNS = (
    labelled(FULL_NAME_LABELS, lambda v: _full(v) | is_caseless(v)), labelled(SINGLE_NAME_LABELS, _person), Pattern(BYLINE, (1,), _shaped(_full), gate=("#",), lines=True),
    Pattern(PROSE, (1,), LOW, gate=CUE_WORDS, lines=True), Pattern(TITLED, (1,), LOW, gate=("dr", "mr", "ms", "mx", "prof", "rev"), lines=True), Pattern(SIGNATURE, (1,), _shaped(_full), gate=CLOSING_WORDS, starts=CLOSING_WORDS),
    Pattern(QUOTED, (1, 2), _shaped(lambda v: looks_like_name(v, True)), within=ABOUT_NAMES),
)
PERSON_SPECIAL = (email_matched, lambda text: table_cells(text, PERSON_COLUMNS, _person))
ORGANIZATION_PATTERNS = (
    labelled(ORGANIZATION_LABELS, _organization, lambda v: _undotted(_field_end(v))), Pattern(COMMENT_ORGANIZATION, (1,), _shaped(looks_like_organization), gate=("#",), lines=True),
    Pattern(COPYRIGHT, (1,), _shaped(looks_like_organization), gate=("copyright",), cut=lambda m: _undotted(m["value"]), lines=True),
    Pattern(SUFFIXED, (1,), _shaped(looks_like_organization), gate=tuple(w.lower() for w in STRONG_SUFFIXES.split("|")), lines=True),
)
ORGANIZATION_SPECIAL = (lambda text: table_cells(text, ORGANIZATION_COLUMNS, _organization),)


def _of_rule(rule_id: str, text: Column) -> Column:
    from .detectors import registry

    return next(d for d in registry() if d.id == rule_id).detect(text)


def person_names(text: Column) -> Column:
    """array<SPAN>: each once, none within a longer one."""
    return _of_rule("person-name", text)


def organization_names(text: Column) -> Column:
    """array<SPAN>: each once, none within a longer one."""
    return _of_rule("org-name", text)
