"""Credentials embedded in source code: found by what dictionary words leave unexplained, and redacted in place."""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.kernel import portions

DICTIONARY = "/opt/tokenizers/byte_bpe_50k.json"
REDACTED = "[REDACTED]"
_LONG_LINE = 20_000


class Segmenter:
    """Splits letters and digits into dictionary words by Viterbi; what no word explains is the residual."""

    def __init__(self, costs: dict[str, float], unknown: float = 9.0):
        self.costs, self.unknown = costs, unknown
        self.longest = max(map(len, costs), default=1)

    @classmethod
    def from_vocabulary(cls, raw: bytes, words: int = 30_000) -> Segmenter:
        """Whole words of a public tokenizer's vocabulary, the earlier an entry the more frequent."""
        vocabulary = json.loads(raw)["model"]["vocab"]
        ranked = sorted((i, t) for t, i in vocabulary.items() if t[:1] == "Ġ" and t[1:].isalpha() and t.isascii() is False and t[1:].isascii())
        costs: dict[str, float] = {}
        for place, (_, t) in enumerate(ranked[:words]):
            w = t[1:].lower()
            if len(w) >= 3:
                costs.setdefault(w, math.log(place + 10) / 1.4 + 1.0)
        return cls(costs)

    def residual(self, text: str) -> int:
        """How many characters of text (digits included, separators not) belong to no dictionary word."""
        return sum(_viterbi(self, part.lower()) for part in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", text))


@lru_cache(maxsize=200_000)
def _viterbi(model: Segmenter, part: str) -> int:
    if part.isdigit():
        return len(part)
    n = len(part)
    best, left = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        best[j], left[j] = best[j - 1] + model.unknown, left[j - 1] + 1
        for i in range(max(0, j - model.longest), j - 2):
            cost = model.costs.get(part[i:j])
            if cost is not None and best[i] + cost < best[j]:
                best[j], left[j] = best[i] + cost, left[i]
    return left[n]


@dataclass(frozen=True)
class Found:
    line: int
    start: int
    end: int
    kind: str


# ---- contexts in which a literal is given

# An identifier that ends in a term for something secret.
_NAME = r"""[\w.\-]*?(?:pass(?:word|wd|phrase|code)?|pwd|(?<![a-zA-Z])pw|rootpw|[_\-]pw|secret|token|credentials?|api[_\-]?key|(?:service|encryption|encrypt|signing|access|private|secret|auth|account|deploy|master|license|storage|shared|client)[_\-]?key)"""
_QUOTED = r"""(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)"""
_JOIN = r"""(?P<more>(?:\s*(?:\+|\.)\s*["'`][^"'`\n]*["'`])*)"""
_ASSIGN = re.compile(rf"""(?i)(?<![\w$])["'`\[]*(?P<name>{_NAME})["'`\]]*(?:\s*:\s*(?:str|string|String))?\s*(?:=>|:=|==?|:|,)\s*(?:[\w.]*\(\s*)?{_QUOTED}{_JOIN}""")
# The rest of a literal that goes on in the next lines, whether code or a diff.
_GOES_ON = re.compile(r"""\s*(?:[+.\\]\s*)?\r?\n[+\- ]?[ \t]*(?:#|//|--)?[ \t]*(?:[+.]\s*)?(["'`])([^"'`\n]+)\1""")
_BARE = re.compile(rf"""(?i)(?<![\w$"'])(?P<name>{_NAME})\s*(?:=|:)\s*(?P<v>[^\s"'`,;<>(){{}}\[\]]+)(?P<rest>[^\n]*)""")
_URL = re.compile(r"""(?i)\b[a-z][a-z0-9+.\-]{1,20}://(?P<user>[^\s:/@"'`<>]*):(?P<v>[^\s/"'`<>]+)@(?=[\w\[$])""")
_SCHEME = re.compile(r"""(?i)\b(?P<s>bearer|basic|token)\s+(?P<v>[A-Za-z0-9_\-.+/=~]{8,})""")
_FLAG = re.compile(r"""(?i)(?:--(?:pass(?:word|wd|phrase)?|pwd|token|secret|api-?key|auth-?token)(?:\s+|=)|\bsshpass\s+-p\s*|\bidentified\s+by\s+|\bpassword\s+|(?<![\w.])pw\s*[=:]\s*|(?<![\w-])-p(?=\S))(?P<q>["'`]?)(?P<v>[^\s"'`;]+)""")
_USERPASS = re.compile(r"""(?:^|\s)-u\s*["']?(?P<user>[^\s:"']+):(?P<v>[^\s"']+)""")
_TAG = re.compile(rf"""(?i)<(?P<name>{_NAME})\b[^<>\n]*>(?P<v>[^<>\n]+)</""")
_ATTRIBUTE = re.compile(rf"""(?i)\b(?:key|name|id)\s*=\s*["'](?P<name>{_NAME})["']\s+value\s*=\s*["'](?P<v>[^"'\n]*)["']""")
_CALL = re.compile(r"""(?i)\b(?P<call>\w+)\s*\(\s*["'`](?P<host>[\w\-]+(?:\.[\w\-]+)+(?::\d+)?|localhost)["'`]\s*,\s*["'`](?P<user>[^"'`\n]*)["'`]\s*,\s*(?P<q>["'`])(?P<v>[^"'`\n]*)(?P=q)""")
_DECODE = re.compile(r"""(?i)\b(?:atob|b64decode|base64decode|decode64|decode(?:String)?|mustDecode|from_?base64(?:String)?|unhexlify|fromhex)\s*\(\s*b?["'`](?P<v>[A-Za-z0-9+/=_\-]{8,})["'`]""")
_PRIVATE = re.compile(r"""-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----""")
_PRIVATE_END = re.compile(r"""-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----""")
_KEY_BODY = re.compile(r"""(?:[A-Za-z0-9+/=\s\\"'`#:,.*|]|-(?!----END ))*+""")
# Formats that are credentials wherever they stand.
_FORMAT = re.compile(
    r"""(?<![A-Za-z0-9_/+])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsru]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w\-]{16,}|xox[abposr]-[0-9A-Za-z\-]{10,}|[sr]k_(?:live|prod)_[0-9A-Za-z]{10,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|AIza[\w\-]{30,}|npm_[A-Za-z0-9]{30,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{10,})(?![A-Za-z0-9_])"""
)
_TOKEN = re.compile(r"""[^\s"'`<>()\[\]{},;|]{6,}""")
_COMMENT = re.compile(r"""^[+\- ]?\s*(?:#|//|--|/?\*|<!--|;\s|rem\b|%\s)""", re.IGNORECASE)
_CODE = re.compile(r"[=({;]")
# A remark that speaks of a credential: the nouns of _NAME, and key, login, account and auth.
_NOUN = re.compile(r"""(?i)(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd?|secret|token|credential|(?:api)?key|log(?:in|on)|account|auth(?:entication|ori[sz]ation)?)s?(?![a-z])""")

# A literal that is given in the line after its name.
_HEAD = re.compile(rf"""(?i)(?<![\w$])["'`\[]*(?P<name>{_NAME})["'`\]]*(?:\s*:\s*(?:str|string))?\s*(?:=>|:=|==?|:)\s*(?P<call>[\w.]*\(\s*)?\\?\s*$""")
_NEXT = re.compile(rf"""\r?\n[+\- ]?[ \t]*(?:#|//|--)?[ \t]*b?{_QUOTED}{_JOIN}""")
_DECODER = re.compile(r"""(?i)(?:atob|decode(?:64|string)?|base64(?:string)?|unhexlify|fromhex)\s*\(\s*$""")

# Which lines are contexts at all: those that a rule above may take, case-blind, in the syntax that both RE2 (over
# whole Arrow batches) and Python read. Each part lets through all that the rule named
# beside it takes.
_KEYS = re.search(r"\(\?:(service\|[^)]*)\)\[_\\-\]\?key", _NAME)[1]
_LOOK = "(?i)" + "|".join(
    [
        r"pass|pwd|pw\b|secret|token\b|credential",  # _NAME, _FLAG
        rf"(?:api|{_KEYS})[_\-]?key\b",
        r"key[\"'`\])]*\s*[:=,]",
        r"://[^\s/\"'@]*:[^\s/]*@",  # _URL
        r"\b(?:bearer|basic)\b",  # _SCHEME
        r"identified|(?:^|[^\w\-])-p[^\s]",  # _FLAG
        r"(?:^|[^\w\-])-u\s*[\"']?[^\s:\"']+:",  # _USERPASS
        r"\([^\w\"'`()]*[\"'`](?:[^\s\"'`]+\.[^\s\"'`]+|localhost)[\"'`][^\w\"'`()]*,",  # _CALL
        r"(?:atob|decode(?:64|string)?|base64(?:string)?|unhexlify|fromhex)[^\w\"'`()]*\(",  # _DECODE
        r"private key",  # _PRIVATE
        r"(?:akia|asia)[a-z0-9]{16}|gh[opsru]_|github_pat_|glpat-|xox[abposr]-|[sr]k_(?:live|prod)_|sg\.[^\s.]{16}|aiza|npm_|eyj[^\s.]{8,}\.eyj",  # _FORMAT
    ]
)
_LOOK_HERE = re.compile(_LOOK, re.ASCII)
# Which lines are remarks or prose: those that _COMMENT matches or that _CODE is not found in.
_REMARK = r"(?i)^[+\- ]?\s*(?:#|//|--|/?\*|<!--|;\s|rem\b|%\s)|^[^=({;]*$"
_REMARK_HERE = re.compile(_REMARK, re.ASCII)

# ---- what a value looks like

_PLACEHOLDER = re.compile(
    r"""(?i)^(?:|[*x.•#_\-]+|<[^>]*>|\$\{?[^}]*\}?|\{\{?.*\}?\}|%\(?\w+\)?s?%?|\[[^\]]*\]|@\w+@|#\{.*\}|.*(?:your[_\- ]|my[_\- ]?(?:pass|secret|token|key)|change[_\- ]?me|change[_\- ]?this|replace|redact|hidden|masked|placeholder|insert|todo|fixme|dummy|sample|paste|set[_\-]in|from[_\-]vault|example$|example[_\-]?key|not[_\-]set|unset).*|none|null|nil|undefined|true|false|empty|n/?a|tbd|secret|password|token|key|string|str|xxx.*)$"""
)
_REFERENCE = re.compile(r"""(?i)(?:^|[^\w])(?:os\.environ|os\.getenv|getenv|process\.env|env\[|env\.|vault|secretsmanager|keyring|config\.|settings\.|self\.|this\.|ctx\.|args\.|opts\.|params\.|import\.meta)""")
_UUID = re.compile(r"""(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$""")
_DIGEST = re.compile(r"""(?i)^(?:sha\d{1,3}|md5|sri)[-:$][A-Za-z0-9+/=]{16,}$|^\$2[aby]?\$|^\$(?:5|6|argon2\w*|scrypt|pbkdf2\w*)\$|^\{(?:S?SHA|MD5)\d*\}|^pbkdf2|^data:""")
_HEX = re.compile(r"""(?i)^[0-9a-f]+$""")
_HASH_CONTEXT = re.compile(r"""(?i)sha|md5|digest|checksum|integrity|commit|rev(?:ision)?\b|etag|fingerprint|hash|nonce|trace|request|built_from|signature\b""")
# A public key or certificate, with the comment of the former, as far as it lies in one line, and an embedded file.
_PUBLIC = re.compile(r"""\bdata:[\w/.+;=\-]*,[A-Za-z0-9+/=%]*|(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2)[\w\-]*(?:\s+[A-Za-z0-9+/=]{16,})?(?:[ \t]+[\w.@\-]+)?|-*BEGIN (?:PUBLIC KEY|CERTIFICATE|RSA PUBLIC)(?:(?!-----END )[^"'`\n])*(?:-----END [A-Z ]+-----)?""")
_MASKED = re.compile(r"""(?:\*{3,}|x{5,}|X{5,}|\.{3,}|•{2,})""")


def _decoded(value: str) -> str | None:
    """The printable text a base64 value stands for, if it does."""
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if text.isprintable() and len(text) >= 4 else None


# How much of a value must be left unexplained (characters of no dictionary word, digits, signs) where it is given.
LEAST = {"login in URL": 2, "basic login": 2, "login option": 2, "option": 3, "login call": 3, "named": 3, "encoded login": 3, "told": 3, "key format": 6, "bearer token": 6}


class Judge:
    """Whether a literal is a credential: by what Viterbi segmentation leaves of it, and the context it stands in."""

    def __init__(self, words: Segmenter):
        self.words = words

    def dismissed(self, v: str) -> bool:
        """Known formats of what is none, and placeholders."""
        return bool(_PLACEHOLDER.match(v) or _REFERENCE.search(v) or _MASKED.search(v) or _UUID.match(v) or _DIGEST.match(v) or len(set(v)) < 4)

    def unexplained(self, v: str, joints: str = "") -> int:
        """Characters of no dictionary word, digits, and signs other than the joints."""
        return self.words.residual(v) + sum(not (c.isalnum() or c == "_" or c.isspace() or c in joints) for c in v)

    def secret(self, context: str, v: str, joints: str = "") -> bool:
        return not self.dismissed(v) and self.unexplained(v, joints) >= LEAST[context]

    def named(self, v: str) -> bool:
        """Given to a secret name: anything of some length that words alone do not explain."""
        v = v.strip()
        if len(v) < 6 or re.search(r"\s", v) or v.isdigit() and len(v) < 8:
            return False
        if re.match(r"^(?:\.{0,2}/)?[\w.\-]+(?:/[\w.\-]+)+$", v) and self.words.residual(v) < 8:
            return False  # a path
        return self.secret("named", v, ".-/")

    def told(self, v: str, noun: bool) -> bool:
        """Told in a remark: what looks like a password by itself, or like a key. Digests and single words with a
        number count only where the remark speaks of a credential."""
        v = v.strip(".,:;")
        if len(v) < 7 or not self.secret("told", v, ".-"):
            return False
        if len(v) >= 20:
            return self._key(v, noun)
        if _HEX.match(v) and len(v) in (7, 8, 32, 40, 64):
            return False
        if re.match(r"^[a-z]+[._]?[a-z]*\d*$", v) or re.match(r"^v?\d+(?:[.\-]\w+)*$", v):
            return False  # a word, a login name, a version
        if re.search(r"[/\\@]|://|\.(?:py|js|ts|go|java|sql|md|sh|json|ya?ml|test|example|invalid|com|org|net|io)\b|^--?\w|^[\w.]+\(|^#", v):
            return False
        return self._password(v, noun)

    def _password(self, v: str, noun: bool) -> bool:
        digits, odd = sum(c.isdigit() for c in v), len(re.findall(r"[^\w.\-]", v))
        residual = self.words.residual(v)
        if not any(c.isalpha() for c in v):
            return False
        if re.match(r"^[A-Za-z]+(?:-[A-Za-z]+)+-\d{2,}$", v):
            return True  # words and a number as a passphrase
        if v.isalpha() and re.search("[a-z][A-Z]", v) and residual >= 7 and residual * 4 > len(v) * 3:
            return True  # letters in mixed case that spell nothing
        if not noun and not odd and residual - digits < 3 and re.match(r"^[A-Za-z]+\d+[A-Za-z]*$", v):
            return False  # words and a number
        mixed = bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(digits) + bool(odd)
        return mixed >= 3 and residual + odd >= 3 and (digits + odd >= 2 or residual >= 6)

    def _key(self, v: str, noun: bool) -> bool:
        """A long key: mostly residual, with digits, no path; no digest unless the remark speaks of a key."""
        residual = self.words.residual(v)
        if re.match(r"^[A-Za-z0-9+/=_.\-]+$", v):
            path = v.count("/") > 3 and residual * 3 < len(v) * 2
            if any(c.isdigit() for c in v) and residual * 2 > len(v) and not path and (noun or not _HEX.match(v)):
                return True
        return not _HEX.match(v) and not re.search(r"[/\\@]|://|^--?\w|^[\w.]+\(|^#", v) and self._password(v, noun)

    def encoded(self, v: str) -> bool:
        text = _decoded(v)
        return text is not None and self.secret("encoded login", text)

    def login(self, v: str) -> bool:
        """A user and a password in base64."""
        user, colon, password = (_decoded(v) or "").partition(":")
        return bool(colon) and self.secret("basic login", password)


def _spans(text: str, begin: int, end: int, judge: Judge) -> Iterator[tuple[int, int, str]]:
    """Credentials of one line, as places in text."""
    line = text[begin:end]
    for m in _PRIVATE.finditer(line):
        close = _PRIVATE_END.search(text, begin + m.end(), begin + m.end() + 20_000) or _key_end(text, begin + m.end())
        yield begin + m.start(), close.end() if close else begin + m.end(), "private key"
    for m in _FORMAT.finditer(line):
        if not re.search(r"EXAMPLE|x{4,}|X{4,}|\*", m.group()) and judge.words.residual(m.group()) >= LEAST["key format"]:
            yield begin + m.start(), begin + m.end(), "key format"
    for m in _URL.finditer(line):
        v = m["v"]
        if len(v) >= 4 and "$" not in v[:2] and judge.secret("login in URL", v):
            yield begin + m.start("v"), begin + m.end("v"), "login in URL"
    public = [(begin + m.start(), begin + m.end()) for m in _PUBLIC.finditer(line)]
    for a, b, kind in _in_context(text, begin, end, line, judge):
        if not any(a < y and x < b for x, y in public):
            yield a, b, kind


def _key_end(text: str, at: int) -> re.Match | None:
    """The end of a private key whose body from `at` on is long, unless what lies between is no key's body."""
    body = _KEY_BODY.match(text, at)
    return _PRIVATE_END.match(text, body.end())


def _in_context(text: str, begin: int, end: int, line: str, judge: Judge) -> Iterator[tuple[int, int, str]]:
    """Credentials of one line that only their context gives away."""
    for m in _SCHEME.finditer(line):
        v = m["v"]
        if judge.dismissed(v):
            continue
        if m["s"].lower() == "basic":
            if judge.login(v):
                yield begin + m.start("v"), begin + m.end("v"), "basic login"
        elif judge.words.residual(v) >= LEAST["bearer token"] and re.search(r"\d", v):
            yield begin + m.start("v"), begin + m.end("v"), "bearer token"
    for m in _DECODE.finditer(line):
        if judge.encoded(m["v"]):
            yield begin + m.start("v"), begin + m.end("v"), "encoded login"
    for pattern, kind in ((_ASSIGN, "named literal"), (_ATTRIBUTE, "named attribute"), (_TAG, "named element")):
        for m in pattern.finditer(line):
            more = m["more"] if kind == "named literal" else ""
            v = m["v"] + "".join(re.findall(r"""["'`]([^"'`]*)["'`]""", more))
            if kind == "named literal" and _DECODE.match(line, m.start("v") - 40 if m.start("v") > 40 else 0):
                continue
            stop = begin + (m.end("more") if more else m.end("v"))
            if kind == "named literal":
                after = stop if more else begin + m.end("v") + 1
                while on := _GOES_ON.match(text, after):
                    v, after = v + on[2], on.end()
                    stop = after
            if judge.named(v) and not (_HEX.match(v) and len(v) in (32, 40, 64, 96, 128) and _HASH_CONTEXT.search(m["name"])):
                yield begin + m.start("v"), stop, kind
    head = _HEAD.search(line)
    m = head and _NEXT.match(text, end)
    if m:
        v, stop, after = m["v"] + "".join(re.findall(r"""["'`]([^"'`]*)["'`]""", m["more"])), m.end("more") if m["more"] else m.end("v"), m.end()
        while on := _GOES_ON.match(text, after):
            v, after = v + on[2], on.end()
            stop = after
        if judge.encoded(v) if _DECODER.search(head["call"] or "") else judge.named(v) and not (_HEX.match(v) and len(v) in (32, 40, 64, 96, 128) and _HASH_CONTEXT.search(head["name"])):
            yield m.start("v"), stop, "named literal"
    for m in _BARE.finditer(line):
        v = m["v"].rstrip(".,")
        if v[:1] in "$*<%" or "(" in m["rest"][:1] or re.match(r"^[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+$", v) and not re.search(r"\d{2}", v) or re.match(r"^[a-z]+(?:_[a-z]+)*$|^[a-z]+[A-Z]\w*$", v) and not re.search(r"\d", v) and judge.words.residual(v) < 4:
            continue
        if re.match(r"\s+[a-z]+\s+[a-z]+\s", m["rest"]) and not re.search(r"\d", v):
            continue
        if judge.named(v):
            yield begin + m.start("v"), begin + m.start("v") + len(v), "named value"
    for m in _CALL.finditer(line):
        if len(m["v"]) >= 6 and judge.secret("login call", m["v"]):
            yield begin + m.start("v"), begin + m.end("v"), "login call"
    for m in _USERPASS.finditer(line):
        if len(m["v"]) >= 6 and judge.secret("login option", m["v"]):
            yield begin + m.start("v"), begin + m.end("v"), "login option"
    for m in _FLAG.finditer(line):
        v = m["v"].rstrip(".,)")
        lead = m.group().lower()
        if lead.startswith("-p") and not re.search(r"(?i)mysql|mongo|psql|redis|pg_|sqlplus|sshpass", line):
            continue
        if len(v) >= 6 and judge.secret("option", v, ".-") and not re.match(r"^[a-z]+(?:[._][a-z]+)*$", v):
            yield begin + m.start("v"), begin + m.start("v") + len(v), "login option"


def _in_remark(line: str, begin: int, judge: Judge) -> Iterator[tuple[int, int, str]]:
    """Credentials told in a remark: every token is segmented, none needs a word of a list beside it."""
    if line.count(" ") < 2 or not _COMMENT.match(line) and _CODE.search(line):
        return
    noun: bool | None = None
    for m in _TOKEN.finditer(line):
        v = m.group().rstrip(".,:;)")
        if v.islower() and v.isalpha():
            continue
        if noun is None:
            spoken = re.findall(r"(?<![\w/+=])[A-Za-z]{2,}(?![\w/+=])", line)
            if len(spoken) < 2:
                return  # no remark but a bare value
            noun = bool(_NOUN.search(line))
        pair = re.match(r"^[A-Za-z][\w.]*:(?P<v>[^:]{6,})$", v)
        if pair and judge.told(pair["v"], noun):
            yield begin + m.start() + pair.start("v"), begin + m.start() + pair.end("v"), "told login"
        elif judge.told(v, noun):
            yield begin + m.start(), begin + m.start() + len(v), "told password"


def find_secrets(text: str, judge: Judge, look: list[tuple[int, bool, bool]] | None = None) -> list[Found]:
    """Every credential of a text in order, without overlaps; lines are counted from 1 and end at line feeds.

    look: the numbers (from 0) of the lines that are contexts, and whether of the rules and whether remarks, if
    they are known already.
    """
    found: list[Found] = []
    lines = text.split("\n")
    if look is None:
        look = [(i, bool(_LOOK_HERE.search(x)), bool(_REMARK_HERE.search(x))) for i, x in enumerate(lines)]
    begins = list(accumulate((len(x) + 1 for x in lines), initial=0)) if look else []
    for i, ruled, remark in look:
        begin, end = begins[i], begins[i] + len(lines[i])
        if found and end <= found[-1].end or not (ruled or remark):
            continue
        spans: set[tuple[int, int, str]] = set()
        if ruled and end - begin <= _LONG_LINE:
            spans.update(_spans(text, begin, end, judge))
        elif ruled:  # a line of bundled code: read around each hit
            done = begin
            for hit in _LOOK_HERE.finditer(text, begin, end):
                if hit.start() >= done:
                    a, b = _window(text, begin, end, hit)
                    spans.update(_spans(text, a, b, judge))
                    done = max(hit.end() + 300, b - 700)
        if remark:
            told = list(_in_remark(lines[i], begin, judge))
            public = [(begin + m.start(), begin + m.end()) for m in _PUBLIC.finditer(lines[i])] if told else []
            spans.update(t for t in told if not any(t[0] < y and x < t[1] for x, y in public))
        for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not found or a >= found[-1].end:
                found.append(Found(i + 1 + text.count("\n", begin, a), a, b, kind))
    return found


def _window(text: str, begin: int, end: int, hit: re.Match) -> tuple[int, int]:
    """What to read around a hit in a long line: 300 characters before it and 700 after it, as far as the
    literals and tokens go that these begin or end in."""
    a, b = max(begin, hit.start() - 300), min(end, hit.end() + 700)
    while a > begin and text[a - 1] not in " \t\"'`,;":
        a -= 1
    stop = b
    for quote in "\"'`":
        if text.find(quote, a, b) >= 0:  # it may be open at b
            close = re.compile(rf"(?:\\\\.|[^\\\\{quote}])*+{quote}(?:\s*[+.]\s*[\"'`][^\"'`\n]*[\"'`])*").match(text, b - (text[b - 1] == "\\"), end)
            stop = max(stop, close.end() if close else stop)
    while stop < end and text[stop] not in " \t\"'`,;":
        stop += 1
    return a, stop


def redact(text: str, found: list[Found], mark: str = REDACTED) -> str:
    """The text with each credential replaced by the mark; all else, quotes and line ends included, stays.

    A private key of several lines keeps its first and last line; of its body each line becomes the mark,
    so that the number of lines and any comment or diff prefix stay."""
    out, at = [], 0
    for f in found:
        out.append(text[at : f.start])
        body = text[f.start : f.end]
        if f.kind == "private key" and "\n" in body:
            lines = body.split("\n")
            inner = [re.sub(r"[A-Za-z0-9+/=]{8,}", mark, x) for x in lines[1:-1]]
            out.append("\n".join([lines[0], *inner, lines[-1]]))
        elif f.kind == "private key":
            out.append(re.sub(r"(PRIVATE KEY(?: BLOCK)?-----).*?(-----END|$)", lambda m: m[1] + mark + m[2], body, flags=re.S))
        elif f.kind == "named literal" and len(parts := re.split(r"""(["'`]\s*[+.\\]?\s*(?:\r?\n[+\- ]?[ \t]*(?:#|//|--)?[ \t]*(?:[+.]\s*)?)?["'`])""", body)) > 1:
            tail = body[-1] if body[-1] in "\"'`" else ""
            parts[-1] = parts[-1].rstrip("\"'`")
            out.append("".join(x if i % 2 else mark for i, x in enumerate(parts)) + tail)
        else:
            out.append(mark)
        at = f.end
    out.append(text[at:])
    return "".join(out)


def lines_to_look_at(texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, bool, bool]]]]:
    """(number of the text, its lines that are contexts, as find_secrets takes them), found by RE2 on all lines of a batch at once."""
    split = pc.split_pattern(texts, "\n")
    first = np.asarray(split.offsets.to_numpy(), np.int64)
    if not len(split.values):
        return
    ruled, remark = (pc.match_substring_regex(split.values, p).to_numpy(zero_copy_only=False) for p in (_LOOK, _REMARK))
    hits = np.flatnonzero(ruled | remark)
    owner = np.searchsorted(first, hits, side="right") - 1
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for lines, own in zip(np.split(hits, cuts), np.split(owner, cuts)):
        if len(lines):
            yield int(own[0]), list(zip((lines - first[own[0]]).tolist(), ruled[lines].tolist(), remark[lines].tolist()))


def _judge_of(raw: bytes) -> Judge:
    key = hash(raw)
    if key not in _JUDGES:
        _JUDGES[key] = Judge(Segmenter.from_vocabulary(raw))
    return _JUDGES[key]


_JUDGES: dict[int, Judge] = {}


def secrets_in(df: DataFrame, text: str, keys: list[str], *, dictionary: str = DICTIONARY) -> DataFrame:
    """One row for each credential in each text: the key columns, line, start, end (characters) and kind.

    Literals are segmented into dictionary words (of a public vocabulary, read by the driver: a fixed
    file) by Viterbi. What is left unexplained makes a literal a credential where it stands in an
    assignment to a secret name, a login, a URL, a header or a remark (LEAST); digests, ids, public keys,
    placeholders and references are excluded by their format. In remarks every token is segmented. A regular
    expression picks the lines that are such a context; whole texts are read, in one pass, without a shuffle.

    Defined results: a null or empty text has no credentials; lines end at line feeds only; a key
    over several lines counts once, where it starts; repeated rows are each reported; lines of over 20,000 characters are read in windows around each hit that
    reach to the end of the literals they open.
    """
    return _run(df, text, keys, dictionary, [T.StructField("line", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())], _rows)


def redacted(df: DataFrame, text: str, keys: list[str], *, dictionary: str = DICTIONARY) -> DataFrame:
    """The key columns, the text with its credentials replaced, and how many there were, for each text that has any."""
    return _run(df, text, keys, dictionary, [T.StructField("redacted_text", T.StringType()), T.StructField("credentials", T.IntegerType())], _redactions)


def _rows(text: str, judge: Judge, look: list[tuple[int, bool, bool]]) -> Iterator[tuple]:
    return ((f.line, f.start, f.end, f.kind) for f in find_secrets(text, judge, look))


def _redactions(text: str, judge: Judge, look: list[tuple[int, bool, bool]]) -> Iterator[tuple]:
    found = find_secrets(text, judge, look)
    if found:
        yield redact(text, found), len(found)


def _run(df: DataFrame, text: str, keys: list[str], dictionary: str, fields: list, rows) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Path(dictionary).read_bytes())
    schema = T.StructType([*[df.schema[k] for k in keys], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge_of(shared.value)
        for batch in (part for whole in batches for part in portions(whole, len(keys), 4 << 20)):
            owner, out = [], [[] for _ in fields]
            for i, look in lines_to_look_at(batch.column(len(keys))):
                for row in rows(batch.column(len(keys))[i].as_py(), judge, look):
                    owner.append(i)
                    for column, v in zip(out, row):
                        column.append(v)
            if owner:
                take = pa.array(owner)
                kinds = {"int": pa.int32(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(len(keys))], *[pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(out, fields)]], names=schema.names)

    return df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("text_")).where("text_ is not null and text_ != ''").mapInArrow(run, schema)
