"""Regular expressions and fixed value lists of the detectors (Java regex dialect).

Word boundaries are spelled out as look-arounds over letters, numbers and
underscore, so they mean the same on every JDK.  Repetition of a group is always
possessive: the regex engine then loops instead of recursing, and a very long
dotted or hyphenated run cannot exhaust the stack of a task.
"""

import re
import sys
import unicodedata
from functools import lru_cache

_WORD = r"[\p{L}\p{N}_]"
# Two look-behinds, because the cheap one already rejects the inside of an ASCII word.
_NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])(?<![\p{L}\p{N}])"
_NOT_BEFORE_WORD = rf"(?!{_WORD})"

# 10/8, 172.16/12 and 192.168/16.  The leading 1 is tested before the boundary
# because that rejects almost every position of a text at once.
_PRIVATE_ADDRESS = (
    rf"1(?<!{_WORD}1)(?:"
    r"0\.\p{Nd}{1,3}\.\p{Nd}{1,3}|"
    r"72\.(?:1[6-9]|2\p{Nd}|3[01])\.\p{Nd}{1,3}|"
    r"92\.168\.\p{Nd}{1,3}"
    r")\.\p{Nd}{1,3}"
)
IPV4 = _PRIVATE_ADDRESS + _NOT_BEFORE_WORD
CIDR = _PRIVATE_ADDRESS + r"/(?:[0-9]|[12][0-9]|3[0-2])" + _NOT_BEFORE_WORD

# A flat name of at most 15 characters.  The first look-ahead keeps only tokens that can
# pass the structural test (a hyphen after the first run, or upper case and digits only);
# a rejected token has no inner boundary, so skipping it finds the same tokens after it.
NETBIOS = (
    _NOT_AFTER_WORD +
    r"(?=[A-Za-z0-9]{1,13}-|[A-Z0-9]{4,15}+(?![a-z]))"
    r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,13}[A-Za-z0-9])?" + _NOT_BEFORE_WORD
)
NETBIOS_STRUCTURAL = r"-|^(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]{4,}$"

# Dotted name whose last label is alphabetic.  _TOP is a place where the name may end.
# After the first label the expression repeats "skip labels that cannot end the name,
# then take one that can", which reaches the last possible end without backtracking.
_TOP = rf"[A-Za-z]{{2,}}+{_NOT_BEFORE_WORD}"
_LABEL_END = r"(?<=[A-Za-z0-9])(?<![A-Za-z0-9-]{64})\."
# A start right after a short whole label is never the leftmost one, because that label
# would have been the start; passing over it keeps long dotted number runs linear.
_NOT_MID_NAME = r"(?:(?<!\.)|(?<!(?<![\p{L}\p{N}_-])[A-Za-z0-9]{1,15}\.))"
_INNER_LABELS = rf"(?:(?!{_TOP})[A-Za-z0-9][A-Za-z0-9-]*+{_LABEL_END})*+"
_NAME_START = _NOT_AFTER_WORD + r"(?=[A-Za-z0-9])(?=[A-Za-z0-9-]{1,63}+(?<=[A-Za-z0-9])\.)"
_NAME = (
    r"[A-Za-z0-9-]++\."
    rf"{_INNER_LABELS}{_TOP}"
    rf"(?:(?:-[A-Za-z0-9-]*+)?+{_LABEL_END}{_INNER_LABELS}{_TOP})*+"
)
FQDN = _NAME_START + _NOT_MID_NAME + _NAME
# The same matches; quadratic in long dotted number runs.
SHORT_FQDN = _NAME_START + _NAME

UPN = (
    rf"(?:(?=[A-Za-z0-9_]){_NOT_AFTER_WORD}|(?=[.%+-])(?<={_WORD}))"
    r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + _NOT_BEFORE_WORD
)
GUID = (
    r"(?=[0-9a-fA-F]{8}-)" + _NOT_AFTER_WORD +
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" +
    _NOT_BEFORE_WORD
)
SID = rf"S(?<!{_WORD}S)-1-5-21-\p{{Nd}}++(?:-\p{{Nd}}++{_NOT_BEFORE_WORD})++"
MAC = (
    r"(?=[0-9a-fA-F]{2}[:-])" + _NOT_AFTER_WORD +
    r"(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}" + _NOT_BEFORE_WORD
)
UNC = r"\\\\[A-Za-z0-9._-]++\\[A-Za-z0-9._$-]++(?:\\[A-Za-z0-9._$-]++)*+"

# File name extensions that are never the end of a host name.
FILE_EXTENSIONS = (
    "txt", "log", "md", "ps1", "py", "js", "html", "css", "json", "xml",
    "csv", "sql", "db", "bak", "tmp", "old", "new", "cfg", "conf", "ini",
    "yml", "yaml", "toml", "properties", "env", "dockerfile", "exe", "dll",
    "zip", "gz", "tar", "rar", "pdf", "doc", "docx", "xls", "xlsx", "png",
    "jpg", "jpeg", "gif", "svg", "ico",
)

# Substrings of a host name that raise its confidence.
HOST_KEYWORDS = (
    "server", "host", "node", "machine", "computer", "desktop",
    "laptop", "sql", "db", "database", "exchange", "mail", "file",
    "backup", "dc", "domain", "controller", "gateway", "router",
    "switch", "firewall", "proxy", "web", "app", "service",
)

# Phrases near a host name that raise its confidence, and how near.
CONTEXT_PHRASES = (
    "connecting to", "connected to", "connection from", "server",
    "hostname", "host:", "target:", "destination:", "source:",
    "forwarding to", "gateway at", "database at", "backup server",
)
CONTEXT_CHARS = 100

# Mail providers whose addresses are not organisational names.
PUBLIC_MAIL_DOMAINS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com",
    "icloud.com", "protonmail.com", "mail.com", "gmx.com", "zoho.com",
)

# Characters that cannot occur in a host name.
ILLEGAL_HOST_CHARS = " /\\:;|<>\"'`~!@#$%^&*()+=[]{}?,"

# An octet above 255, in an address the patterns above have matched.
OCTET_TOO_LARGE = r"2(?:5[6-9]|[6-9][0-9])|[3-9][0-9][0-9]"

DATE_SHAPE = r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}\n?\z"


@lru_cache
def decimal_digit_table() -> tuple[str, str]:
    """Every decimal digit of Unicode outside ASCII, and its ASCII counterpart."""
    wide = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(wide), "".join(str(unicodedata.decimal(c)) for c in wide)


@lru_cache
def python_pattern(pattern: str) -> re.Pattern:
    """A pattern of this module in Python's dialect, where \\w is [\\p{L}\\p{N}_] and \\d is \\p{Nd}."""
    pattern = pattern.replace(_NOT_AFTER_WORD, r"(?<!\w)")
    return re.compile(pattern.replace(_WORD, r"\w").replace(r"[\p{L}\p{N}]", r"[^\W_]").replace(r"\p{Nd}", r"\d").replace(r"\z", r"\Z"))


_DOT_TOP = re.compile(r"\.[A-Za-z]{2}")
_FLAT = re.compile(r"(?=[A-Z0-9]{4})[0-9]*[A-Z]")


def possible_kinds(word: str) -> list[str]:
    """The kinds that may have a match in a word, told by plain characters that every match holds."""
    kinds, hyphens = [], word.count("-")
    if "." in word:
        if "10." in word or "172." in word or "192.168." in word:
            kinds += ["ipv4", "cidr"] if "/" in word else ["ipv4"]
        if _DOT_TOP.search(word):
            kinds += ["fqdn", "upn"] if "@" in word else ["fqdn"]
    if hyphens or _FLAT.search(word):
        kinds.append("netbios")
        if hyphens >= 4:
            kinds.append("guid")
            if "S-1-5-21-" in word:
                kinds.append("sid")
    if hyphens + word.count(":") >= 5:
        kinds.append("mac")
    if "\\\\" in word:
        kinds.append("unc")
    return kinds


_UPN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_UPN_START = re.compile(r"(?=[A-Za-z0-9_])(?<!\w)|(?=[.%+-])(?<=\w)")
_UPN_DOMAIN = re.compile(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)")


def find_upns(text: str):
    """Matches of UPN, looked for from the signs backwards: what a match may begin with in the run of characters before a
    sign does not change where it ends."""
    upn, end = python_pattern(UPN), 0
    for domain in _UPN_DOMAIN.finditer(text):
        start = domain.start()
        while start > end and text[start - 1] in _UPN_CHARS:
            start -= 1
        if begin := _UPN_START.search(text, start, domain.start()):
            yield upn.match(text, begin.start(), domain.end())
            end = domain.end()


_LABEL_BEFORE = re.compile(r"(?<![\w-])[A-Za-z0-9]{1,15}\.\Z")


def find_names(text: str):
    """Matches of FQDN in a long text.  Starts right after a short whole label are passed over, as _NOT_MID_NAME does, which
    Python's dialect cannot say."""
    start, name, at = python_pattern(_NAME_START), python_pattern(_NAME), 0
    while found := start.search(text, at):
        at = found.start()
        middle = at and text[at - 1] == "." and _LABEL_BEFORE.search(text[max(at - 17, 0):at])
        match = None if middle else name.match(text, at)
        if match:
            yield match
        at = match.end() if match else at + 1
