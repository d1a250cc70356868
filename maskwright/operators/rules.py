"""The built-in rules, in their order; the secret rules are one bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.config import CN, US, Rule
from maskwright.functions import validators as V

_DIGIT = lambda t: t.rlike("[0-9]")
_HAS = lambda s: lambda t: F.contains(t, F.lit(s))

#: Patterns, scores and flags.
_SEG = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
#: The same matches: they start where a run of such signs does or at the last match's end, so long runs take linear time.
EMAIL = Rule("email", "EMAIL", r"(?:\G|(?<![A-Za-z0-9._%+\-]))" + EMAIL_PATTERN.replace("]+@", "]++@"), 0.9, likely=_HAS("@"))
BANK_CARD = Rule("bank_card", "BANKCARD", "[0-9]{13,19}", 0.9, boundary=True, predicate=V.luhn, likely=lambda t: t.rlike("[0-9]{13}"))
IP = Rule("ip", "IP", rf"(?<![A-Za-z0-9_]){_SEG}(?:\.{_SEG}){{3}}(?![A-Za-z0-9_])", 0.7, likely=lambda t: t.rlike(r"[0-9]\.[0-9]"))
URL = Rule("url", "URL", r"https?:\/\/[^\x20\x09\x0a\x0c\x0d]+", 0.8, likely=_HAS("://"))
INTL_PHONE = Rule("intl_phone", "PHONE", r"\+[1-9][0-9]{5,14}", 0.8, boundary=True, likely=_HAS("+"))
CHINA_PHONE = Rule("china_phone", "PHONE", "1[3-9][0-9]{9}", 0.7, CN, boundary=True, likely=lambda t: t.rlike("[0-9]{11}"))
CHINA_IDCARD = Rule("china_idcard", "IDCARD", "[1-9][0-9]{16}[0-9Xx]", 0.95, CN, boundary=True, predicate=V.china_id, likely=lambda t: t.rlike("[0-9]{17}"))
CHINA_LANDLINE = Rule("china_landline", "LANDLINE", "0[0-9]{2,3}-[0-9]{7,8}", 0.7, CN, boundary=True, likely=_HAS("-"))
US_SSN = Rule("us_ssn", "SSN", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.85, US, boundary=True, predicate=V.ssn, likely=_HAS("-"))
US_PHONE = Rule("us_phone", "PHONE", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.7, US, boundary=True, likely=_HAS("("))
_FENCES = "PGP PRIVATE KEY BLOCK|RSA PRIVATE KEY|EC PRIVATE KEY|OPENSSH PRIVATE KEY|DSA PRIVATE KEY|ENCRYPTED PRIVATE KEY|PRIVATE KEY"
PRIVATE_KEY = Rule("private_key", "PRIVATEKEY", rf"-----BEGIN ({_FENCES})-----[\s\S]*?-----END \1-----", 1.0, likely=_HAS("-----BEGIN "))
ENTROPY = Rule(
    "entropy_password",
    "SECRET",
    r"(?i:api[_-]?key|secret|password|passwd|pwd)[A-Z0-9_]*[\"']?[ \t\n\r\f]*(?::=|[:=])[ \t\n\r\f]*(\"[^\"]*\"|'[^']*'|[^ \t\n\r\f\"']+)",
    0.7,
    predicate=lambda m: V.entropy(V.unquoted(m)) >= 3.0,
    likely=lambda t: t.rlike("(?i)key|secret|passw|pwd"),
    group=1,
)
# The next three are reconstructed from public token formats; they can be replaced like any rule.
CLOUD_KEY = Rule("cloud_key", "CLOUDKEY", "AKIA[0-9A-Z]{16}|(?:LTAI|AKID)[0-9A-Za-z]{12,}", 0.95, likely=lambda t: t.rlike("AKIA|LTAI|AKID"))
JWT = Rule("jwt", "JWT", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0.95, likely=_HAS("eyJ"))
GIT_TOKEN = Rule("git_token", "GITTOKEN", "gh[po]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}", 0.95, likely=lambda t: t.rlike("gh[po]_|glpat-"))
SECRET = (CLOUD_KEY, PRIVATE_KEY, JWT, GIT_TOKEN, ENTROPY)
DEFAULT = (EMAIL, BANK_CARD, IP, URL, INTL_PHONE, SECRET, CHINA_PHONE, CHINA_IDCARD, CHINA_LANDLINE, US_SSN, US_PHONE)


#: Words of which one begins with another, and so on, deeper than this stay a plain list, longest first.
MAX_NESTING = 200


def _quoted(part: str) -> str:
    return r"\Q" + part.replace(r"\E", r"\E\\E\Q") + r"\E"


def _tree(words: list[str], at: int, depth: int) -> str | None:
    """A pattern for the rests from place `at` of sorted distinct words, the longest first; null if it nests too deep.

    Rests that begin alike share a branch, so at each place one branch at most goes on, however many words there are.
    """
    if depth > MAX_NESTING:
        return None
    ends, rest = len(words[0]) == at, words[1:] if len(words[0]) == at else words
    branches, start = [], 0
    for i in range(1, len(rest) + 1):
        if i == len(rest) or rest[i][at] != rest[start][at]:
            first, last = rest[start], rest[i - 1]
            cut = at + 1
            while cut < min(len(first), len(last)) and first[cut] == last[cut]:
                cut += 1
            tail = _tree(rest[start:i], cut, depth + 1)
            if tail is None:
                return None
            branches.append(_quoted(first[at:cut]) + tail)
            start = i
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)}){'?' if ends else ''}"


def keyword_rule(words: tuple[str, ...]) -> Rule:
    """Leftmost-longest literals: a pattern tree over their code points, entered only at a sign that a word begins with."""
    own = sorted(set(words))
    tree = _tree(own, 0, 0)
    if tree is None:
        tree = "|".join(_quoted(w) for w in sorted(own, key=lambda w: (-len(w), w)))
    starts = "".join(rf"\x{{{ord(c):x}}}" for c in sorted({w[0] for w in own}))
    return Rule("keyword", "KEYWORD", f"(?=[{starts}])(?:{tree})", 1.0)
