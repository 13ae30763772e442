"""The detector registry: what each rule is called, how it ranks, and its native span expression.

bearer-token, api-key, jwt and secret-assignment are reconstructed from described behaviour; their bounds are choices within it.
person-name and org-name are procedural and live in names.py.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.spans import HIGH, LOW, MEDIUM, SPAN, Pattern, as_spans, fold, jvm, matches, no_spans

@dataclass(frozen=True)
class Detector:
    """explanation: what it finds, for people. special: functions of the text that give array<SPAN>, for what patterns can't say."""

    id: str
    name: str
    category: str
    severity: str
    label: str
    priority: int
    patterns: tuple[Pattern, ...]
    #: "balanced", "strict", "pack" or "lead": where the rule is on by default. Leads are found but not replaced.
    mode: str = "balanced"
    template: str | None = None
    normalize: Callable[[Column], Column] | None = None
    #: Of the string literals of the text and a match, with before and after: what replaces it in code, or null.
    replacement: Callable[[Column, Column], Column] | None = None
    explanation: str = ""
    special: tuple[Callable[[Column], Column], ...] = ()
    #: Of its own matches, those within longer ones go before rules are compared.
    tidy: bool = False
    #: Its number among the rules whose matches are made before the scan, in column GIVEN.
    given: int | None = None

    @property
    def strict_only(self) -> bool:
        return self.mode == "strict"

    @property
    def pack_only(self) -> bool:
        return self.mode == "pack"

    @property
    def review_lead(self) -> bool:
        return self.mode == "lead"

    def detect(self, text: Column) -> Column:
        """array<SPAN> of all its matches, by place."""
        found = F.array_sort(F.concat(as_spans(matches(text, self.patterns)), *(s(text) for s in self.special)))
        return tidied(found) if self.tidy else found


def tidied(found: Column) -> Column:
    """Each span once, none within a longer one, by start. A fold over the spans by start, longest first: a span goes if an earlier
    one ends where it ends or later."""
    order = F.array_sort(F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("i"), s.alias("s"))))

    def step(done: Column, x: Column) -> tuple[dict[str, Column], Column]:
        new = x["s"]["end"] > done["end"]
        return {"end": F.greatest(done["end"], x["s"]["end"])}, F.when(new, F.array(x["s"])).otherwise(no_spans())

    return fold(order, {"end": F.lit(-1)}, step, SPAN)["out"]


def checked(test: Callable[[Column], Column], rank: int | Column = HIGH) -> Callable[[Column], Column]:
    return lambda v: F.when(test(v), rank if isinstance(rank, Column) else F.lit(rank))


# Patterns and lists of the rules.
PRIVATE_KEY = r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY((?: BLOCK)?)-----[\s\S]+?-----END \1PRIVATE KEY\2-----"
URL_CREDENTIAL = r"""(?i)\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|amqps?|mssql|sqlserver|oracle|ftps?|sftp|ldaps?|https?)://[^\s/:@"']+:[^\s@"']+@[^\s"'<>]+"""
ADO_CONNECTION = r"""(?i)\b(?:Data Source|Server|Host|Address|Initial Catalog|Database|User Id|User ID|Uid|User)[ \t]*=[ \t]*[^;\r\n]+;(?:[ \t]*[A-Za-z][A-Za-z ]*[ \t]*=[ \t]*[^;\r\n]+;)*?[ \t]*(?:Password|Pwd)[ \t]*=[ \t]*[^;\r\n"']+;?"""
CARD = r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"
SECURE_STRING = r"""(?i)ConvertTo-SecureString\s+(?:-String\s+)?["']([^"'\r\n]{4,})["']"""
DISTINGUISHED_NAME = r"(?i)\b(?:(?:CN|OU|O|L|ST)=[^,;=\r\n]{1,64},\s*)*DC=[A-Za-z0-9-]{1,63}(?:,\s*DC=[A-Za-z0-9-]{1,63})+"
GUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
GUID_LABELS = ("tenant", "client", "object", "subscription", "application", "app", "directory", "resource", "user", "account", "principal")
#: A label may be the end of a longer word.
LABELED_GUID = rf"""(?i)(?=[{''.join(sorted({w[0] for w in GUID_LABELS}))}])(?:{'|'.join(GUID_LABELS)})[-_ ]?id\b\s*[:=]\s*["']?({GUID})\b"""
URL = r"""(?i)\b(?:https?|ldaps?)://[^\s"'<>)\]]+"""
UNC = r"""\\\\[A-Za-z0-9][A-Za-z0-9._-]{0,253}\\[^\\\s"'<>|]+(?:\\[^\\\s"'<>|]+)*\\?"""
UNIX_PATH = r"""(?:/home|/Users)/[A-Za-z0-9._-]+(?:/[^\s"'<>|]*)?"""
EMAIL = r"(?<![$A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\b"
_DOMAIN = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\b"
#: A fragment or a labelled domain that runs into an address is none: the address is found instead.
NO_ADDRESS = rf"(?![A-Za-z0-9._%+-]*@{_DOMAIN})"
EMAIL_FRAGMENT = r"@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\b"
MAIL_DOMAIN = r"""(?i)\b(?:email|mail|upn|user[ _-]?principal[ _-]?name|accepted|tenant)[ _-]?(?:domain|suffix)\b[ \t]*[:=][ \t]*["']?((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})\b"""
ASSIGNMENT = r"""(\$[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*|(?<![$\w])[A-Za-z_][A-Za-z0-9_]*)\s*=\s*(["'])([^"'\r\n]{2,})\2"""
INFRASTRUCTURE_KEYS = ("smtpserver", "connectionuri", "hostname", "endpoint", "server", "host", "domain", "fqdn", "uri", "url")
INFRASTRUCTURE_VALUE = r"^(?:[A-Za-z0-9][A-Za-z0-9._-]*(?::\d{2,5})?(?:/[^\s]*)?|(?i:https?)://[^\s]+)\z"
ACCOUNT = r"""(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([A-Za-z][A-Za-z0-9._@-]{1,63}))"""
ACCOUNT_PARAMETER = rf"(?i)-(?:SamAccountName|UserPrincipalName|UserName)\s+{ACCOUNT}"
ACCOUNT_COMMAND = rf"(?i)\b(?:Get-ADUser|Set-ADUser|Remove-ADUser|Enable-ADAccount|Disable-ADAccount|Unlock-ADAccount|Set-ADAccountPassword|Get-Mailbox|Set-Mailbox|Remove-Mailbox)\b[^\r\n;|]*?-Identity\s+{ACCOUNT}"
IPV6 = r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{2,45}(?![0-9A-Za-z:.])"
MAC = r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2})([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
VERSION_CUE = r"""(?i)(?:\b(?:v|version|ver|rev|build|release|assembly|fileversion|assemblyversion)|\b[a-z][a-z0-9_-]*version)(?:[ \t"'(=:>+]|\[){0,16}\z"""
PORTS = (21, 22, 23, 25, 53, 110, 143, 389, 445, 465, 587, 636, 993, 995, 1433, 1521, 3306, 3389, 5432, 5985, 5986, 8080)
HOST_PORT = r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,62})?(?:\.[a-z0-9](?:[a-z0-9-]{0,62})?)+|\d{1,3}(?:\.\d{1,3}){3}):([0-9]{1,5})\b"
LABELED_PORT = r"(?i)\b(?:(?:Port|SMTP port|LDAP port|RDP port|SSH port|WinRM port)[ \t]*[:=]?[ \t]*)([0-9]{1,5})\b"
HOSTNAME = r"(?i)\b[a-z0-9](?:[a-z0-9-]{0,62})?(?:\.[a-z0-9](?:[a-z0-9-]{0,62})?){1,}\b"
TENANT_HOST = r"(?i)\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.onmicrosoft\.com\b"
AD_GROUPS = (
    r"""(?i)\b(?:Add|Remove|Get)-ADGroupMember\b[^\r\n|;]*?-Identity\s+(['"])([^'"\r\n]{2,80})\1""",
    r"""(?i)-MemberOf\s+(['"])([^'"\r\n]{2,80})\1""",
    r"""(?i)\bNew-ADGroup\b[^\r\n|;]*?-Name\s+(['"])([^'"\r\n]{2,80})\1""",
)
SERVICE_TICKET = r"\b(?:INC|CHG|REQ|RITM|PRB|SCTASK|TASK)\d{5,}\b"
ISSUE_KEY = r"\b[A-Z]{2,10}-\d{2,6}\b"
NO_ISSUE = ("UTF", "ISO", "RFC", "CVE", "SHA", "MD", "TLS", "HTTP", "IPV", "X")
ACCOUNT_NAMES = ("user", "login", "logon", "account", "upn")
USERNAME = r"""(?i)\b(?:user(?:name)?|login|logon|account|samaccountname|userprincipalname|upn)\b\s*[:=]\s*["']?([A-Za-z][A-Za-z0-9._@-]{1,63})\b"""
PHONE = r"""\b(?:[Pp]hone(?:[ _]?[Nn]umber)?|[Mm]obile|[Cc]ell|[Tt]el(?:ephone)?|[Ff]ax)\b[ \t]*[:=][ \t]*["']?((?:\+?1[ \t.-]?)?\(?\d{3}\)?[ \t.-]?\d{3}[ \t.-]?\d{4}(?:[ \t]*(?:x|ext\.?)[ \t]*\d{1,5})?)(?![\d-])"""
ADDRESS = r"""\b(?:[Ss]treet[ _]?[Aa]ddress|[Hh]ome[ _]?[Aa]ddress|[Mm]ailing[ _]?[Aa]ddress|[Aa]ddress|[Ss]treet)\b[ \t]*[:=][ \t]*["']?(\d{1,6}[ \t]+[A-Za-z0-9 .,'#/-]{3,78}[A-Za-z0-9.])"""
BIRTH_DATE = r"""\b(?:DOB|[Dd]ate[ _]?[Oo]f[ _]?[Bb]irth|[Bb]irth[ _]?[Dd]ate|[Bb]irthday)\b[ \t]*[:=][ \t]*["']?(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|[A-Z][a-z]+ \d{1,2},? \d{4})\b"""
SIN_LABELED = r"""\b(?:SIN|[Ss]ocial[ \t]?[Ii]nsurance(?:[ \t]?[Nn]umber)?)\b[ \t]*[:#=][ \t]*["']?(\d{3}[ \t-]?\d{3}[ \t-]?\d{3})\b"""
SIN_GROUPED = r"(?<![\d-])\d{3}([ -])\d{3}\1\d{3}(?![\d-])"
HEALTH_ID = r"""\b(?:MRN|[Mm]edical[ \t]?[Rr]ecord(?:[ \t]?[Nn]umber)?|[Hh]ealth[ \t]?[Cc]ard(?:[ \t]?[Nn]umber)?|HCN|PHN|[Pp]atient[ \t]?[Ii][Dd])\b[ \t]*[:#=][ \t]*["']?([A-Za-z0-9-]{6,15})\b"""
PASSPORT = r"""(?i)\b(?:Passport(?:[ \t]+(?:Number|No))?|Travel[ \t]+Document[ \t]+Number)\b[ \t]*[:#=][ \t]*["']?([A-Z0-9]{6,12})(?![A-Z0-9])"""
IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{1,4})+(?![A-Za-z0-9])"
SSN_LABELED = r"""(?i)\b(?:SSN|Social[ \t]?Security(?:[ \t]?(?:Number|No))?|Soc[ \t]?Sec)\b[ \t]*[:#=][ \t]*["']?(\d{3}[ -]?\d{2}[ -]?\d{4})(?![\d-])"""
SSN_GROUPED = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ABA = r"""(?i)\b(?:ABA(?:[ \t]+routing)?|routing(?:[ \t]+transit)?(?:[ \t]+number)?|bank[ \t]+routing)\b[ \t]*[:#=][ \t]*["']?(\d{9})(?!\d)"""
ITIN = r"""(?i)\b(?:ITIN|Individual[ \t]+Taxpayer[ \t]+Identification(?:[ \t]+Number)?)\b[ \t]*[:#=][ \t]*["']?(9\d{2}[ -]?\d{2}[ -]?\d{4})(?!\d)"""
EIN = r"""(?i)\b(?:EIN|Employer[ \t]+Identification(?:[ \t]+Number)?|Federal[ \t]+Tax[ \t]+ID)\b[ \t]*[:#=][ \t]*["']?(\d{2}-\d{7})(?!\d)"""
DEA = r"""(?i)\b(?:DEA(?:[ \t]+registration)?(?:[ \t]+number|[ \t]+no)?|DEA#)\b[ \t]*[:#=]?[ \t]*["']?([A-Z]{2}\d{7})(?![A-Z0-9])"""
POSTAL_CONTEXT = r"(?i)\b(?:Postal[ _]?Code|ZIP(?:[ _]?Code)?|Address|Street|Mailing[ _]?Address|Home[ _]?Address|City|Location)\b[ \t]*[:=]"
POSTAL_CODE = r"\b[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z][ ]?\d[ABCEGHJ-NPRSTV-Z]\d\b"
ZIP_CONTEXT = r"(?i)\b(?:ZIP(?:[ _]?Code)?|Postal[ _]?Code|Address|Street|Mailing[ _]?Address|City|State)\b[ \t]*[:=]"
ZIP = r"(?<![\d-])\d{5}(?:-\d{4})?(?![\d-])"
ARTIFACT = r"(?i)\b[A-Za-z0-9_-]*(?:cycle_state|run_state|last_run|runstamp|run_stamp|audit|snapshot)[A-Za-z0-9_-]*\.(?:json|xml|csv|log|txt)\b"
CLIXML = r"(?i)\b[A-Za-z0-9_-]{2,}\.clixml\b"
DIRECTORY_ATTRIBUTE = r"(?i)\b(?:SamAccountName|UserPrincipalName|DistinguishedName|CanonicalName|DisplayName|otherTelephone|otherIpPhone|otherFacsimileTelephoneNumber|pwdLastSet|ProxyAddresses)\b"
DIRECTORY_WORD = r"""(?<=[.$'"-])(?:mail|Enabled)\b"""
EXCHANGE_TERM = r"(?i)\b(?:Get-Recipient|RecipientTypeDetails|RemoteUserMailbox|RemoteSharedMailbox|UserMailbox|SharedMailbox|Enable-RemoteMailbox|RemoteRoutingAddress|Import-PSSession)\b"
EXCHANGE_SESSION = r"(?i)\bNew-PSSession\b[^\r\n|;]*?-ConfigurationName\s+Microsoft\.Exchange\b"
CREDENTIAL_TERM = r"(?i)\b(?:Export-Clixml|Import-Clixml|PSCredential|Send-MailMessage|InitializeSmtpCredential|SmtpCredentialPath|DefaultSmtpUsername)\b"
HISTORY_LINE = r"(?i)(?<![^\r\n\u2028\u2029])[ \t]*#[^\r\n]*\b(?:Author|Modified|Created|Updated|Revision|Rev|History|Changed)\b[^\r\n]*"
INITIALS = r"(?<![A-Za-z0-9])[A-Z]{2,3}(?![A-Za-z0-9])"
NO_INITIALS = (
    "AD", "AND", "API", "CSV", "DB", "DC", "DEV", "DNS", "FIX", "HR", "ID", "IIS", "IP", "IT", "LOG", "NEW", "NOT", "OLD", "OU",
    "PC", "PS", "QA", "SQL", "SMTP", "TODO", "UAT", "UI", "UPN", "URL", "USB", "VM", "VPN", "WIP", "XML",
)
HEADER_LINE = r"(?im)^[ \t]*#[ \t]*(?:Author|Owner|Company|Organization|Organisation|Department|Team|Contact|Maintainer|Written by|Created by|Modified by|Reviewed by)[ \t]*[:=-][ \t]*([^\r\n]{2,80}?)[ \t]*$"
HELP_LINE = r"(?im)^[ \t]*\.(?:AUTHOR|COMPANYNAME)[ \t]+([^\r\n]{2,80}?)[ \t]*$"
IDENTITY_FIELDS = (
    "employee id", "employeeid", "ad username", "adusername", "username", "upn", "userprincipalname", "samaccountname", "email",
    "e-mail", "first name", "firstname", "last name", "lastname", "display name", "displayname", "access id", "accessid",
    "access password", "activation date", "deactivation date", "status", "comments",
)
#: Of three different ones of these fields, one at least has one of these parts: only two fields have none.
IDENTITY_PARTS = ("employee", "name", "upn", "mail", "access", "activation date")
SERVER_NAMES = ("server", "-computername", "-domaincontroller")
SERVER_PARAMETER = r"""(?i)-(?:Server|ComputerName|SmtpServer|DomainController|ConnectionServer)\s+["']?([A-Za-z0-9][A-Za-z0-9._-]{1,253})\b"""

# Reconstructed rules: token shapes with chosen length bounds.
BEARER = r"(?i)\bBearer[ \t]+[A-Za-z0-9._~+/-]{16,}=*"
JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
API_KEYS = (
    r"\bsk-ant-[A-Za-z0-9_-]{20,}", r"\bsk-proj-[A-Za-z0-9_-]{20,}", r"\b[srp]k_(?:live|test)_[A-Za-z0-9]{16,}", r"\bsk-[A-Za-z0-9]{20,}",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}", r"\bgithub_pat_[A-Za-z0-9_]{22,}", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}",
    r"\bAIza[A-Za-z0-9_-]{35}", r"\bglpat-[A-Za-z0-9_-]{20,}", r"\bglrt-[A-Za-z0-9_-]{20,}",
    r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{43}", r"\bnpm_[A-Za-z0-9]{36}", r"\bya29\.[A-Za-z0-9_-]{20,}", r"AccountKey=[A-Za-z0-9+/]{86}==",
    r"https://hooks\.slack\.com/services/[A-Za-z0-9/]+", r"(?i)Authorization:[ \t]*Basic[ \t]+[A-Za-z0-9+/]{8,}=*", r"\bdop_v1_[0-9a-f]{64}\b",
    r"\bpypi-[A-Za-z0-9_-]{50,}", r"\bdckr_pat_[A-Za-z0-9_-]{20,}", r"\bhf_[A-Za-z0-9]{30,}", r"\bhvs\.[A-Za-z0-9_-]{20,}", r"\bdapi[0-9a-f]{32}\b",
    r"\bshpat_[0-9a-fA-F]{32}\b", r"\bnfp_[A-Za-z0-9]{30,}", r"\bxkeysib-[0-9a-f]{64}", r"\bAGE-SECRET-KEY-1[A-Z0-9]{58}\b",
    r"https://(?:ptb\.|canary\.)?discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+",
)
#: Of which every one of these keys has one, in small letters.
API_KEY_PARTS = (
    "sk-", "k_live_", "k_test_", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "aiza", "glpat-", "glrt-", "sg.", "npm_", "ya29.", "accountkey=",
    "hooks.slack.com", "authorization:", "dop_v1_", "pypi-", "dckr_pat_", "hf_", "hvs.", "dapi", "shpat_", "nfp_", "xkeysib-", "age-secret-key-", "/api/webhooks/",
)
PLAIN_API_KEYS = (r"\b(?:AC|SK)[0-9a-f]{32}\b", r"\b[0-9]{8,10}:[A-Za-z0-9_-]{35}\b")
SIGNATURES = (r"[?&]sig=([A-Za-z0-9%+/=_-]{20,})", r"[?&]X-Amz-Signature=([0-9a-fA-F]{64})")
SECRET_NAMES = ("passw", "passphrase", "pwd", "userpass", "secret", "key", "token")
SECRET_ASSIGNMENT = r"""(?i)(?:password|passwd|passphrase|pwd|userpass|secret|client_secret|api_?key|access_?token|auth_?token|token)["']?\s*[:=]\s*["']([^"'\r\n]{4,})["']"""


def _any_of(patterns: tuple[str, ...]) -> str:
    """One of the patterns. Of those that start at a word, where a letter or digit follows, the bound is looked at once for all; no
    other one starts like them."""
    words = [p.removeprefix(r"\b") for p in patterns if p.startswith(r"\b")]
    return "|".join((rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})", *(f"(?:{p})" for p in patterns if not p.startswith(r"\b"))))


def no_version(m: Column) -> Column:
    """Not part of a longer dotted run of numbers, and not after a word for versions on its line."""
    line = F.regexp_extract(m["before"], r"[^\r\n]*\z", 0)
    return ~(m["before"].rlike(r"\d\.\z") | m["after"].rlike(r"^\.\d") | line.rlike(jvm(VERSION_CUE)))


def _infrastructure(m: Column) -> Column:
    leaf = F.lower(F.regexp_replace(F.element_at(F.split(m["extra"], r"\."), -1), "[$_-]", ""))
    return leaf.rlike(f"(?:{'|'.join(INFRASTRUCTURE_KEYS)})\\z") & m["value"].rlike(jvm(INFRASTRUCTURE_VALUE))


def _iban(m: Column) -> Column:
    """The longest run of leading groups that is valid; empty if there is none."""
    groups = F.split(m["value"], " ")
    heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    return F.coalesce(F.get(F.filter(heads, lambda h: V.is_iban(F.replace(h, F.lit(" "), F.lit("")))), F.lit(0)), F.lit(""))


def _identity_header(value: Column) -> Column:
    cells = F.transform(F.split(value, ",", -1), lambda c: F.lower(F.regexp_replace(F.trim(c), "^[\"']|[\"']\\z", "")))
    hits = F.size(F.array_intersect(cells, F.array(*map(F.lit, IDENTITY_FIELDS))))
    return F.when((F.size(cells) >= 3) & (hits >= 3), F.when(hits >= 4, MEDIUM).otherwise(LOW))


def _line_with(context: str, gate: tuple[str, ...]) -> Pattern:
    """A line, without its end, that the context is on."""
    return Pattern(rf"(?<![^\n])[^\n]*(?:{context})[^\n]*", gate=gate, lines=True)


def _ranked_host(v: Column) -> Column:
    return F.when(~V.is_ipv4(v) & V.is_internal_host(v), F.when(V.has_internal_label(v), HIGH).otherwise(MEDIUM))


def registry(as_of: datetime.date | None = None) -> list[Detector]:
    """All rules in order; order is the last tie-break. as_of bounds dates of birth (today by default)."""
    year = (as_of or datetime.date.today()).year
    port = checked(lambda v: v.try_cast("int").isin(*PORTS), MEDIUM)
    account = checked(lambda v: v.rlike(r"^[A-Za-z][A-Za-z0-9._@-]{1,63}\z"), MEDIUM)
    sin, ssn = checked(V.is_sin), checked(V.is_ssn)
    postal = _line_with(POSTAL_CONTEXT, ("postal", "zip", "address", "street", "city", "location"))
    zips = _line_with(ZIP_CONTEXT, ("zip", "postal", "address", "street", "city", "state"))
    history = Pattern(HISTORY_LINE, gate=("#",))
    from . import names, paths

    def rule(id_: str, name: str, category: str, severity: str, label: str, priority: int, explanation: str, *patterns: Pattern, mode: str = "balanced", **more) -> Detector:
        return Detector(id_, name, category, severity, label, priority, patterns, mode, explanation=explanation, **more)

    return [
        rule("private-key", "Private key block", "secrets", "high", "PRIVATE_KEY", 97, "A whole private key in text form.", Pattern(PRIVATE_KEY, gate=("private key",), starts=("private key",))),
        rule("connection-string", "Connection string with credentials", "secrets", "high", "CONNECTION_STRING", 93, "An address or list of settings for a connection that has a password in it.",
             Pattern(URL_CREDENTIAL, gate=("://",), lines=True), Pattern(ADO_CONNECTION, gate=("password", "pwd"), lines=True)),
        rule("payment-card", "Payment card number", "personal", "high", "CREDIT_CARD", 84, "Digits of a known card issuer with a valid check digit.",
             Pattern(CARD, number=True, lines=True, gate=r"(?:\d[ -]?){12}\d", confidence=lambda v: F.when(V.is_card(v), F.when(v.rlike("[ -]"), HIGH).otherwise(MEDIUM)))),
        rule("bearer-token", "Bearer token", "secrets", "high", "TOKEN", 95, "A token that grants access to whoever holds it.", Pattern(BEARER, gate=("bearer",), lines=True)),
        rule("api-key", "API key", "secrets", "high", "API_KEY", 90, "A key in the form of a known provider, or a signed address.",
             Pattern(_any_of(API_KEYS), gate=API_KEY_PARTS, lines=True), Pattern(_any_of(PLAIN_API_KEYS), gate=r"(?=[AS0-9])(?:(?:AC|SK)[0-9a-f]{32}|\d{8}:)", lines=True),
             Pattern(SIGNATURES[0], (1,), gate=("sig=",), lines=True), Pattern(SIGNATURES[1], (1,), gate=("x-amz-signature=",), lines=True)),
        rule("jwt", "JSON web token", "secrets", "high", "JWT", 86, "A signed web token in three parts.", Pattern(JWT, gate=("eyj",), lines=True)),
        rule("secure-string-literal", "SecureString literal", "secrets", "high", "SECRET", 88, "A password written out where it is made secure.", Pattern(SECURE_STRING, (1,), gate=("convertto-securestring",), starts=("convertto-securestring",))),
        rule("ad-dn", "AD distinguished name", "infrastructure", "medium", "AD_DN", 85, "A directory object's full name, with the domain.", Pattern(DISTINGUISHED_NAME, gate=("dc=",), starts=("cn=", "ou=", "o=", "l=", "st=", "dc="))),
        rule("guid-identifier", "GUID identifier", "infrastructure", "medium", "GUID", 82, "An identifier of a tenant, an application or another object.",
             Pattern(LABELED_GUID, (1,), has=("-",), gate="[0-9A-Fa-f]-[0-9A-Fa-f]{4}-", starts=GUID_LABELS), Pattern(rf"\b{GUID}\b", confidence=LOW, has=("-",), gate="[0-9A-Fa-f]-[0-9A-Fa-f]{4}-", lines=True)),
        rule("secret-assignment", "Secret assignment", "secrets", "high", "SECRET", 80, "A quoted value that is given to something named like a secret.",
             Pattern(SECRET_ASSIGNMENT, (1,), checked(lambda v: ~v.rlike(r"^(?:[$\[(<{@].*|[*•.x]+|(?i:true|false|null|none|prompt))\z")), gate=SECRET_NAMES, starts=SECRET_NAMES)),
        rule("internal-url", "Internal URL", "infrastructure", "medium", "INTERNAL_URL", 75, "An address of a host within an organization.", Pattern(URL, confidence=checked(lambda v: V.is_internal_host(V.host_of(v))), gate=("://",), lines=True)),
        rule("unc-path", "UNC network path", "paths", "medium", "UNC_PATH", 73, "A path on a file server.", Pattern(UNC, gate=("\\\\",), lines=True)),
        rule("windows-user-path", "Windows path", "paths", "low", "FILE_PATH", 72, "A path on a drive, which may show a user or a project.", paths.WINDOWS),
        rule("unix-user-path", "Unix user path", "paths", "low", "FILE_PATH", 72, "A path below a user's home.", Pattern(UNIX_PATH, gate=("/home", "/users"), lines=True)),
        rule("email", "Email address / domain", "personal", "medium", "EMAIL", 70, "An address, or the mail domain of an organization.",
             Pattern(rf"{EMAIL}|{EMAIL_FRAGMENT}{NO_ADDRESS}", gate=("@",), lines=True), Pattern(rf"{MAIL_DOMAIN}{NO_ADDRESS}", (1,), gate=("domain", "suffix"), lines=True)),
        rule("ps-infrastructure-assignment", "Infrastructure assignment", "infrastructure", "medium", "INTERNAL_HOST", 74, "A host or address that is given to something named like one.",
             Pattern(ASSIGNMENT, (3,), MEDIUM, has=("=",), gate=r"""=\s*["']""", extra=1, test=_infrastructure)),
        rule("ps-identity-param", "PowerShell identity parameter", "personal", "low", "USERNAME", 68, "An account that a command is called with.",
             Pattern(ACCOUNT_PARAMETER, (1, 2, 3), account, gate=("-samaccountname", "-userprincipalname", "-username")), Pattern(ACCOUNT_COMMAND, (1, 2, 3), account, gate=("-identity",))),
        rule("ps-server-param", "PowerShell server parameter", "infrastructure", "medium", "INTERNAL_HOST", 68, "A server that a command is called with.",
             Pattern(SERVER_PARAMETER, (1,), MEDIUM, gate=SERVER_NAMES, starts=SERVER_NAMES)),
        rule("ipv6", "IPv6 address", "infrastructure", "medium", "IP_ADDRESS", 66, "A network address in the newer form.",
             Pattern(IPV6, confidence=lambda v: F.when(V.is_ipv6(v), F.when(v.isin("::", "::1"), LOW).otherwise(HIGH)), has=(":",), gate="::|:[0-9A-Fa-f]+:", lines=True)),
        rule("mac-address", "MAC address", "infrastructure", "medium", "MAC_ADDRESS", 66, "The address of a network card.",
             Pattern(MAC, confidence=checked(lambda v: ~F.upper(F.regexp_replace(v, "[:-]", "")).isin("0" * 12, "F" * 12)), gate="[:-](?<=[0-9A-Fa-f]{2}[:-])[0-9A-Fa-f]{2}[:-]", lines=True)),
        rule("ipv4", "IPv4 address", "infrastructure", "medium", "IP_ADDRESS", 65, "A network address.",
             Pattern(IPV4, confidence=checked(lambda v: V.is_ipv4(v) & ~v.startswith("127.") & ~v.isin("0.0.0.0", "255.255.255.255")), number=True, has=(".",), gate=r"\d\.\d", test=no_version, lines=True)),
        rule("network-port", "Network port", "infrastructure", "low", "PORT", 35, "The port of a well-known service.",
             Pattern(HOST_PORT, (1,), port, number=True, has=(":",), gate=r"[A-Za-z0-9]:\d"), Pattern(LABELED_PORT, (1,), port, gate=("port",), number=True)),
        rule("internal-hostname", "Internal hostname", "infrastructure", "medium", "INTERNAL_HOST", 60, "A host within an organization, or its tenant.",
             Pattern(HOSTNAME, confidence=_ranked_host, has=(".",), gate=r"\.(?<=[A-Za-z0-9]\.)[A-Za-z0-9]", lines=True), Pattern(TENANT_HOST, confidence=checked(lambda v: ~v.rlike(rf"^{jvm(HOSTNAME)}\z")), gate=("onmicrosoft.com",))),
        rule("ad-group-name", "AD group name", "directory", "medium", "AD_GROUP", 66, "A group that a command is called with.",
             *(Pattern(p, (2,), gate=(g,), starts=(g,)) for p, g in zip(AD_GROUPS, ("-adgroupmember", "-memberof", "new-adgroup"), strict=True))),
        rule("ticket-id", "Ticket / issue ID", "infrastructure", "low", "TICKET_ID", 55, "The number of a ticket or issue.",
             Pattern(SERVICE_TICKET, number=True, gate=r"[A-Z]\d{5}", lines=True), Pattern(ISSUE_KEY, confidence=checked(lambda v: ~F.substring_index(v, "-", 1).isin(*NO_ISSUE), MEDIUM), number=True, has=("-",), gate=r"[A-Z]-\d", lines=True)),
        rule("username", "Username", "personal", "low", "USERNAME", 50, "An account after a label.", Pattern(USERNAME, (1,), MEDIUM, gate=ACCOUNT_NAMES, starts=ACCOUNT_NAMES)),
        rule("person-name", "Person name", "personal", "medium", "NAME", 52, "What looks like a person's name after a label, a cue or a title, or in a table.", *names.PERSON_PATTERNS, mode="strict", special=names.PERSON_SPECIAL, tidy=True),
        rule("org-name", "Organization name", "personal", "medium", "ORG", 51, "What looks like an organization's name after a label or by its last word, or in a table.", *names.ORGANIZATION_PATTERNS, mode="strict", special=names.ORGANIZATION_SPECIAL, tidy=True),
        rule("canadian-sin", "Canadian SIN", "personal", "high", "SIN", 62, "A Canadian insurance number with a valid check digit.",
             Pattern(SIN_LABELED, (1,), sin, gate=("sin", "insurance"), number=True, lines=True), Pattern(SIN_GROUPED, confidence=checked(V.is_sin, MEDIUM), number=True, lines=True, gate=r"\d[ -]\d{3}[ -]\d{3}"), mode="strict"),
        rule("health-identifier", "Health identifier", "personal", "high", "HEALTH_ID", 61, "A number of a patient, record or health card.",
             Pattern(HEALTH_ID, (1,), checked(lambda v: F.regexp_count(v, F.lit(r"\d")) >= 4), gate=("mrn", "record", "card", "hcn", "phn", "patient"), number=True, lines=True), mode="strict"),
        rule("phone-number", "Phone number", "personal", "medium", "PHONE", 57, "A telephone number after a label.", Pattern(PHONE, (1,), gate=("phone", "mobile", "cell", "tel", "fax"), number=True, lines=True), mode="strict"),
        rule("date-of-birth", "Date of birth", "personal", "high", "DOB", 56, "A birth date that exists.", Pattern(BIRTH_DATE, (1,), checked(lambda v: V.is_birth_date(v, year)), gate=("dob", "birth"), number=True, lines=True), mode="strict"),
        rule("physical-address", "Physical address", "personal", "medium", "ADDRESS", 54, "A street address after a label.", Pattern(ADDRESS, (1,), MEDIUM, gate=("address", "street"), number=True, lines=True), mode="strict"),
        rule("passport-number", "Passport number (labeled field)", "personal", "high", "PASSPORT", 60, "A number of a passport after a label.",
             Pattern(PASSPORT, (1,), checked(lambda v: v.rlike("(?i)[A-Z]") & v.rlike(r"\d")), gate=("passport", "travel"), number=True, lines=True), mode="strict"),
        rule("iban", "IBAN", "personal", "high", "IBAN", 91, "A bank account number with valid length and checksum.", Pattern(IBAN, number=True, lines=True, gate=r"[A-Za-z]{2}\d{2}", cut=_iban), mode="pack"),
        rule("us-ssn", "US SSN", "personal", "high", "SSN", 63, "A US social security number that could have been given out.",
             Pattern(SSN_LABELED, (1,), ssn, gate=("ssn", "soc"), number=True, lines=True), Pattern(SSN_GROUPED, confidence=checked(V.is_ssn, MEDIUM), number=True, lines=True, has=("-",), gate=r"\d-\d{2}-\d"), mode="pack"),
        rule("us-aba-routing", "ABA routing number", "personal", "high", "ROUTING_NUMBER", 64, "A US bank's routing number with a valid checksum.", Pattern(ABA, (1,), checked(V.is_aba), gate=("aba", "routing"), number=True, lines=True), mode="pack"),
        rule("us-itin", "ITIN", "personal", "high", "ITIN", 63, "A US taxpayer number of a valid range.", Pattern(ITIN, (1,), checked(V.is_itin), gate=("itin", "taxpayer"), number=True, lines=True), mode="pack"),
        rule("us-ein", "EIN", "personal", "high", "EIN", 62, "A US employer's tax number after a label.", Pattern(EIN, (1,), number=True, lines=True, has=("-",), gate=r"\d{2}-\d{7}"), mode="pack"),
        rule("us-dea-number", "DEA number", "personal", "high", "DEA_NUMBER", 63, "A US prescriber's number with a valid checksum.", Pattern(DEA, (1,), checked(V.is_dea), gate=("dea",), number=True, lines=True), mode="pack"),
        rule("ca-postal-code", "Canadian postal code", "personal", "medium", "POSTAL_CODE", 53, "A Canadian postal code on a line about an address.", Pattern(POSTAL_CODE, within=postal), mode="pack"),
        rule("us-zip", "US ZIP code", "personal", "low", "ZIP", 52, "A US postal code on a line about an address.", Pattern(ZIP, confidence=MEDIUM, within=zips), mode="pack"),
        rule("workflow-artifact", "Workflow artifact", "workflow", "low", "WORKFLOW_FILE", 35, "A file that tells how work is done.",
             Pattern(ARTIFACT, confidence=MEDIUM, gate=("cycle_state", "run_state", "last_run", "runstamp", "run_stamp", "audit", "snapshot"), lines=True), Pattern(CLIXML, confidence=MEDIUM, gate=(".clixml",), lines=True), mode="lead"),
        rule("directory-attribute", "Directory attribute", "directory", "low", "DIR_ATTRIBUTE", 34, "A directory field that a script uses.",
             Pattern(DIRECTORY_ATTRIBUTE, confidence=LOW, gate=("name", "othertelephone", "otheripphone", "otherfacsimile", "pwdlastset", "proxyaddresses")), Pattern(DIRECTORY_WORD, confidence=LOW, gate=("mail", "enabled")), mode="lead"),
        rule("exchange-workflow", "Exchange workflow", "messaging", "low", "EXCHANGE_TERM", 33, "A step of managing mailboxes.",
             Pattern(EXCHANGE_TERM, confidence=LOW, gate=("get-recipient", "recipienttypedetails", "mailbox", "remoteroutingaddress", "import-pssession")), Pattern(EXCHANGE_SESSION, confidence=MEDIUM, gate=("new-pssession",)), mode="lead"),
        rule("credential-workflow", "Credential workflow", "workflow", "low", "CRED_WORKFLOW", 32, "A step that stores or uses credentials.",
             Pattern(CREDENTIAL_TERM, confidence=LOW, gate=("-clixml", "pscredential", "send-mailmessage", "smtpcredential", "defaultsmtpusername")), mode="lead"),
        rule("author-initials", "Author initials", "personal", "low", "INITIALS", 31, "Initials in a comment on changes.", Pattern(INITIALS, confidence=checked(lambda v: ~v.isin(*NO_INITIALS), LOW), within=history), mode="lead"),
        rule("header-metadata", "Header metadata", "workflow", "low", "HEADER_META", 36, "Who wrote or owns a script, by its header.", Pattern(HEADER_LINE, (1,), LOW, gate=("#",)), Pattern(HELP_LINE, (1,), LOW, gate=(".author", ".companyname")), mode="lead"),
        rule("csv-identity-header", "CSV identity header", "workflow", "low", "CSV_SCHEMA", 30, "A header of a table of people.", Pattern(r"(?<![^\n])([^\n]*,[^\n]*,[^\n]*[^\s])", (1,), _identity_header, has=(",",), gate=IDENTITY_PARTS, lines=True), mode="lead"),
    ]


__all__ = ["SPAN", "Detector", "registry"]
