"""Files that nobody wrote by hand here: generated, minified, vendored or bulk data.

Linear support-vector classifiers over hashed character n-grams and path components, trained on
labels that giveaways provide (headers, suffixes, folders, licence files beside a file), with those
headers masked in the features; plus a stage that finds copies in other projects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.kernel import IS_DIGIT, IS_LETTER, IS_SPACE, LOWER, Words, count_in, mix, portions, text_buffer, words_of
from lintlake.sources.tables import materialize

CLASSES = ("generated", "minified", "vendored", "data")

# ---- giveaways: they label the training files, and are masked in what the classifiers read

_COMMENT = r"[ \t﻿]*(?:#|//|--|/\*+!?|\*|<!--|;|%|\"\"\"|''')[^\n]*"
_COMMENT_LINE = re.compile(_COMMENT)
# What a comment line says: that a tool wrote the file (as linguistic conventions of generators have it, in three
# languages), that it comes from another project, or that it is under a licence. In the syntax that RE2 reads too.
_TOOL_SAYS = r"\bauto-?\s?generated\b|\bgenerated (?:by|file|from|code|at|on|with|using)\b|\bcode generated\b|@generated\b|\bautomatically (?:generated|produced|created)\b|\bmachine[- ](?:written|generated|made)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bgenerado autom|\bregenerate (?:rather than|instead of|it|this)\b|\bdo not (?:edit|modify)\b[^\n]{0,25}(?:\.|by hand|manually|\n|$)|\bmanual changes will be lost\b|\boverwritten (?:on|by|at) the next\b"
_COPY_SAYS = r"\b(?:copied|vendored|imported|adapted|taken|bundled|ported)\b[^\n]{0,40}\bfrom\b|\b(?:bundled|vendored|verbatim|unmodified) copy\b|\bupstream (?:revision|commit|version|tag)\b|@(?:license|preserve) \S+ v?\d|\bhttps?://\S+/releases?/v?\d|\b\d+\.\d+\.\d+\b[^\n]*(?:\blicen[sc]ed?\b|\bcopyright\b|\(c\))"
_LICENCE_SAYS = r"\bcopyright\b|\blicen[sc]ed?\b|\bspdx\b|\ball rights reserved\b|\buse is permitted\b|\(c\)"
_SAYS = f"(?i){_TOOL_SAYS}|{_COPY_SAYS}|{_LICENCE_SAYS}"
_TOOL_HEADER, _COPY_HEADER, _ANY_HEADER = (re.compile(f"(?i){x}") for x in (_TOOL_SAYS, _COPY_SAYS, f"{_TOOL_SAYS}|{_COPY_SAYS}|{_LICENCE_SAYS}"))
# A line that only speaks of such things: it negates them, or names them as its object.
_NO_HEADER = re.compile(r"(?i)\b(?:not|never|no longer|used to be|if|the) (?:been )?(?:auto-?\s?|automatically )?(?:generated|produced|created|copied)\b|\bthe automatically\b")

_TOOL_FILE = re.compile(r"(?i)(?:(?:^|/)zz_generated[^/]*|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.(?:gen|g|generated|designer)\.\w+|[-.]lock\.\w+|(?:^|/)(?:package-lock|npm-shrinkwrap|composer|yarn|poetry|pipfile|cargo|gemfile)(?:-lock|\.lock)(?:\.\w+)?|package-\w*lock\w*\.json|\.lock|\.map)$")
_TOOL_TEXT = re.compile(r"\A\s*\{\s*\"(?:lockVersion|lockfileVersion|_lock)\"|\"mappings\"\s*:\s*\"[A-Za-z0-9+/,;]{20}")
_MIN_FILE = re.compile(r"(?i)[.\-]min\.(?:js|css|mjs)$|\.bundle\.js$")
_COPY_FOLDER = {"vendor", "_vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "extern", "external", "deps", "jspm_packages", "site-packages"}
_COPY_BESIDE = re.compile(r"(?i)^(?:licen[sc]e|copying|authors|changelog|changes|version|upstream|notice|contributors)(?:\.(?:md|txt|rst|adoc|html))?$")


def _told(lines: list[str], says: list[bool]) -> tuple[bool, bool, str | None]:
    """(a tool is named as the author, another project is named as the source, the text without the comment lines
    that say something of origin or licence, or None if there are none). says: which lines may."""
    tool = copy = False
    drop = set()
    for i, said in enumerate(says):
        if said and _COMMENT_LINE.match(lines[i]):
            plain = not _NO_HEADER.search(lines[i])
            tool, copy = tool or plain and bool(_TOOL_HEADER.search(lines[i])), copy or plain and bool(_COPY_HEADER.search(lines[i]))
            drop.add(i)
    return tool, copy, "\n".join("" if i in drop else x for i, x in enumerate(lines)).lstrip("\n\r ") if drop else None


def giveaways(text: str) -> tuple[bool, bool, str]:
    """(a tool is named as the author, another project is named as the source, the text with such lines masked)."""
    lines = text.split("\n")
    tool, copy, rest = _told(lines, [bool(_ANY_HEADER.search(x)) for x in lines])
    return tool, copy, text if rest is None else rest


def giveaways_of(texts: pa.Array) -> list[tuple[bool, bool, str]]:
    """giveaways() of every text; RE2 finds the lines that say anything in two passes, over the texts and over the lines of those that do."""
    out = [(False, False, t) for t in texts.to_pylist()]
    hit = np.flatnonzero(pc.match_substring_regex(texts, _SAYS).to_numpy(zero_copy_only=False)) if len(texts) else []
    if len(hit):
        split = pc.split_pattern(texts.take(pa.array(hit)), "\n")
        says, at = pc.match_substring_regex(split.values, _SAYS).to_pylist(), split.offsets.to_pylist()
        for i, a, b in zip(hit.tolist(), at, at[1:]):
            text = out[i][2]
            tool, copy, rest = _told(text.split("\n"), says[a:b])
            out[i] = tool, copy, text if rest is None else rest
    return out


def beside(structure: str | None) -> dict[str, set[str]]:
    """Files in each folder of a printed tree."""
    found: dict[str, set[str]] = {}
    stack: list[str] = []
    for line in (structure or "").splitlines():
        m = re.match(r"^((?:│   |    |\|   )*)(?:├── |└── |\|-- |`-- |\+-- )(.+?)/?\s*$", line)
        if m:
            depth = len(m[1]) // 4
            stack[depth:] = [m[2]]
            found.setdefault("/".join(stack[:depth]), set()).add(m[2])
    return found


# ---- features

GRAMS, SHAPES, PATHS = 1 << 12, 1 << 10, 1 << 10
_NUMBERS = 11
WIDTH = GRAMS + SHAPES + PATHS + _NUMBERS
_SHAPE = LOWER.copy()
_SHAPE[IS_LETTER] = ord("a")
_SHAPE[IS_DIGIT] = ord("0")
_PLAIN = LOWER.copy()
_PLAIN[IS_DIGIT] = ord("0")


def _hashed(codes: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Buckets of the n-grams of a byte array, one for each place but the last n - 1."""
    h = np.zeros(max(len(codes) - n + 1, 0), np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + codes[k : k + len(h)]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())).astype(np.int64)


def path_tokens(path: str) -> list[str]:
    """Folders as they are but for numbers, the parts of the file's name, and pairs of them with their role."""
    folders, _, name = path.replace("\\", "/").rpartition("/")
    parts = [re.sub(r"\d+", "0", p.lower()) for p in folders.split("/") if p and p != "."]
    pieces = [p for p in re.split(r"[._\-]+", re.sub(r"[0-9a-f]*\d[0-9a-f]*", "0", name.lower())) if p]
    return [*("d:" + p for p in parts), *("n:" + p for p in pieces), "e:" + ".".join(pieces[-2:]), "x:" + (pieces[-1] if pieces else ""), f"depth:{len(parts)}"]


def _fnv(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def features(masked: pa.Array, paths: list[str | None]) -> np.ndarray:
    """One row for each file: log counts of hashed character n-grams and shapes, path components, layout numbers."""
    raw, offsets = text_buffer(masked)
    n = len(paths)
    out = np.zeros((n, WIDTH), np.float32)
    if len(raw):
        owner = np.repeat(np.arange(n), np.diff(offsets))
        grams = _hashed(_PLAIN[raw], 4, GRAMS)
        same = owner[: len(grams)] == owner[3:] if len(grams) else np.zeros(0, bool)
        out[:, :GRAMS] = np.bincount(owner[: len(grams)][same] * GRAMS + grams[same], minlength=n * GRAMS).reshape(n, GRAMS)
        shapes = _hashed(_SHAPE[raw], 6, SHAPES)
        same = owner[: len(shapes)] == owner[5:] if len(shapes) else np.zeros(0, bool)
        out[:, GRAMS : GRAMS + SHAPES] = np.bincount(owner[: len(shapes)][same] * SHAPES + shapes[same], minlength=n * SHAPES).reshape(n, SHAPES)
    for i, path in enumerate(paths):
        for t in path_tokens(path or ""):
            out[i, GRAMS + SHAPES + _fnv(t) % PATHS] += 1.0
    for a, b in ((0, GRAMS), (GRAMS, GRAMS + SHAPES), (GRAMS + SHAPES, GRAMS + SHAPES + PATHS)):
        block = np.log1p(out[:, a:b])
        out[:, a:b] = block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-6)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    lines = count_in(raw == 10, offsets) + 1.0
    newline = np.flatnonzero(raw == 10)
    edges = np.union1d(np.r_[offsets, newline], [])
    gaps = np.diff(edges)
    at = np.minimum(np.searchsorted(offsets, edges[:-1], side="right") - 1, n - 1) if len(edges) > 1 else np.zeros(0, np.int64)
    longest = np.zeros(n)
    np.maximum.at(longest, at, gaps)
    numbers = [np.log(size / lines) / 4, np.log1p(longest) / 6, count_in(IS_DIGIT[raw], offsets) / size, count_in(IS_LETTER[raw], offsets) / size, count_in(IS_SPACE[raw], offsets) / size, count_in(np.isin(raw, [40, 41, 59, 61, 123, 125]), offsets) / size, count_in(np.isin(raw, [44, 59]), offsets) / size, np.log(size) / 10, count_in(raw >= 128, offsets) / size, np.ones(n), _repeated_lines(raw, offsets)]
    out[:, -_NUMBERS:] = np.stack(numbers, 1)
    return out


def _repeated_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of each text's lines that an earlier line of it equals but for its numbers and white space."""
    n = len(offsets) - 1
    digit = IS_DIGIT[raw]
    keep = ~IS_SPACE[raw] & ~(digit & np.r_[False, digit[:-1]]) if len(raw) else np.zeros(0, bool)
    line_of = np.zeros(len(raw), np.int64)
    if len(raw):
        breaks = raw == 10
        breaks[offsets[1:-1][offsets[1:-1] < len(raw)] - 1] = True  # each text begins a line
        line_of[1:] = np.cumsum(breaks)[:-1]
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(n)
    line, code = line_of[at], _PLAIN[raw[at]].astype(np.uint64) + np.uint64(1)
    start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    powers = np.cumprod(np.full(int(place.max()) + 1, np.uint64(0x100000001B3)), dtype=np.uint64)
    hashed = np.add.reduceat(code * powers[place], start)
    text = np.searchsorted(offsets, at[start], side="right") - 1
    key = mix(hashed + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.bincount(text, minlength=n)[:n]
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    distinct = np.bincount(text[order][fresh], minlength=n)[:n]
    return np.where(total >= 12, (total - distinct) / np.maximum(total, 1), 0.0)


def bulk_share(text: str) -> float:
    """Share of a text's bytes in lines that hold numbers, hexadecimal or base64 digits only."""
    bulk = sum(len(m.group()) for m in re.finditer(r"(?m)^[\s\d.,;:|\-+eExX\[\](){}'\"]{12,}$|^\s*[\"'`]?[A-Za-z0-9+/]{56,}={0,2}[\"'`]?[,\\]?\s*$|^\s*[\"']?(?:0x)?[0-9a-f]{32,}[\"']?,?\s*$|(?:-?\d+(?:\.\d+)?[\s,;\[\]]+){12,}|(?:0x[0-9a-fA-F]{1,16}[\s,;]*){8,}|(?i:^\s*insert into \S+ .*values\s*\(.*$)|^\s*[\"']?\w+[\"']?\s*:\s*-?[\d.]+,\s*$", text))
    return bulk / max(len(text), 1)


def labels(path: str, text: str, tool: bool, copy: bool, siblings: set[str]) -> list[bool]:
    """Which classes the giveaways name."""
    folders = set(path.lower().split("/")[:-1])
    lines = text.count("\n") + 1
    dense = bool(re.search(r"\.(?:js|css|mjs|ts)$", path)) and len(text) > 500 and len(text) / lines > 250
    return [tool or bool(_TOOL_FILE.search(path)) or bool(_TOOL_TEXT.search(text)), bool(_MIN_FILE.search(path)) or dense, copy or bool(folders & _COPY_FOLDER) or ("/" in path and sum(bool(_COPY_BESIDE.match(s)) for s in siblings) >= 1), bulk_share(text) > 0.6]


# ---- training


_PRECISION = 0.985


@dataclass
class Model:
    weights: np.ndarray  # WIDTH x classes
    bias: np.ndarray
    bar: np.ndarray  # how far above 0 a class counts where no giveaway speaks for it
    report: list[tuple]  # class, training files, positives, validation files, positives, precision, recall

    def scores(self, x: np.ndarray) -> np.ndarray:
        """How far each file is over the bar of each class."""
        return x @ self.weights + self.bias - self.bar


def fit_svm(x: np.ndarray, y: np.ndarray, use: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, c: float = 1.0, newton: int = 7, inner: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Linear support-vector classifiers (squared hinge, L2) of the rows in use, all classes at once, by
    Newton steps with conjugate gradients from `start` on. Rows out of use weigh nothing, so that x is never copied."""
    n, width = x.shape
    c = (c * use.astype(np.float32))[:, None]
    sign = np.where(y, 1.0, -1.0).astype(np.float32)
    w, b = start or (np.zeros((width, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32))
    soft = np.float32(1e-3)  # the bias is hardly punished
    for _ in range(newton):
        slack = np.maximum(0.0, 1.0 - sign * (x @ w + b))
        pull = (2.0 * c) * slack * sign
        gw, gb = w - x.T @ pull, soft * b - pull.sum(0)
        size = np.sqrt((gw**2).sum(0) + gb**2)
        if float(size.max()) < 1e-2 * np.sqrt(n):
            break
        live = (2.0 * c) * (slack > 0).astype(np.float32)
        dw, db = np.zeros_like(w), np.zeros_like(b)
        rw, rb = -gw, -gb
        pw, pb = rw.copy(), rb.copy()
        rr = (rw**2).sum(0) + rb**2
        start = rr.copy()
        for _ in range(inner):
            along = live * (x @ pw + pb)
            hw, hb = pw + x.T @ along, soft * pb + along.sum(0)
            alpha = rr / np.maximum((pw * hw).sum(0) + pb * hb, 1e-12)
            dw, db = dw + alpha * pw, db + alpha * pb
            rw, rb = rw - alpha * hw, rb - alpha * hb
            now = (rw**2).sum(0) + rb**2
            if bool((now <= 1e-3 * start).all()):
                break
            pw, pb = rw + now / np.maximum(rr, 1e-12) * pw, rb + now / np.maximum(rr, 1e-12) * pb
            rr = now
        loss = (c * slack**2).sum(0) + 0.5 * (w**2).sum(0)
        step = np.ones(y.shape[1], np.float32)
        for _ in range(8):  # shorter where a class would get worse
            trial = np.maximum(0.0, 1.0 - sign * (x @ (w + step * dw) + b + step * db))
            worse = (c * trial**2).sum(0) + 0.5 * ((w + step * dw) ** 2).sum(0) > loss + 1e-4
            if not worse.any():
                break
            step = np.where(worse, step / 2, step).astype(np.float32)
        w, b = w + step * dw, b + step * db
    return w, b


def train(files: list[tuple]) -> Model:
    """files: (root, path, content, siblings). A fifth of the repositories is held out, for the report alone.

    Unlabelled files count as hand-written, but for those whose lines repeat as a tool writes them and
    those that classifiers trained on other repositories find near the other side: a missing
    giveaway proves nothing, so they teach nothing. The bar of each class is the lowest that keeps
    the precision on the other half of the repositories than the classifier was trained on; neither decision sees the
    held-out fifth."""
    fold = np.array([_fnv(root or "") % 5 for root, *_ in files], np.int64)
    part = np.where(fold == 0, 0, np.where(fold < 3, 1, 2))  # held out, and two halves: each lies together
    order = np.argsort(part, kind="stable")
    files, part = [files[i] for i in order], part[order]
    masked, given, paths = [], [], []
    for a in range(0, len(files), 256):
        block = files[a : a + 256]
        for (_, path, _, siblings), (tool, copy, rest) in zip(block, giveaways_of(pa.array([f[2] for f in block], pa.large_string()))):
            masked.append(rest)
            given.append(labels(path, rest, tool, copy, siblings))
            paths.append(path)
    y = np.array(given, bool).reshape(-1, len(CLASSES))
    if not len(y) or not y.any():
        return Model(np.zeros((WIDTH, len(CLASSES)), np.float32), np.full(len(CLASSES), -1.0, np.float32), np.zeros(len(CLASSES), np.float32), [])
    x = np.empty((len(paths), WIDTH), np.float32)
    for a in range(0, len(paths), 128):
        x[a : a + 128] = features(pa.array(masked[a : a + 128], pa.large_string()), paths[a : a + 128])
    cut = np.searchsorted(part, [0, 1, 2, 3])
    halves = [slice(cut[1], cut[2]), slice(cut[2], cut[3])]
    alone = cut[1] in (0, len(part))  # nothing is held out, or all is
    held, learn = slice(0, cut[1]), slice(0, len(part)) if alone else slice(cut[1], len(part))
    labelled = y.any(1)
    code = np.array([bool(re.search(r"\.(?:py|pyi|js|mjs|jsx|ts|tsx|go|java|rs|c|cc|cpp|h|cs|rb|php|kt|scala|sql)$", p)) for p in paths])
    unsure = ~labelled & code & (x[:, -1] > 0.6)  # lines repeat as a tool writes them, but nothing says so
    score, crossed = np.zeros(y.shape, np.float32), np.zeros(len(y), bool)  # of each half by the other half's classifiers
    known: list[tuple[np.ndarray, np.ndarray]] = []
    for half, rest in (halves, halves[::-1]):
        use = ~unsure[rest]
        if half.stop > half.start and y[rest][use].any():
            known.append(fit_svm(x[rest], y[rest], use))
            score[half] = x[half] @ known[-1][0] + known[-1][1]
            crossed[half] = True
    told = np.delete(score, CLASSES.index("vendored"), 1)  # a copy reads like any code
    unsure |= crossed & ~labelled & (told.max(1) > -0.25)
    clean = np.zeros(len(y), bool)
    clean[learn] = ~unsure[learn]
    middle = (sum(k[0] for k in known) / len(known), sum(k[1] for k in known) / len(known)) if known else None
    w, b = fit_svm(x[learn], y[learn], clean[learn], middle)
    # A class whose giveaways say more than the texts do needs a higher bar.
    bar = np.zeros(len(CLASSES), np.float32)
    for k in range(len(CLASSES)):
        own = score[crossed & ~unsure, k], y[crossed & ~unsure, k]
        if own[1].sum() >= 5:
            bars = np.arange(0.0, 1.01, 0.05)
            exact = [((own[0] > t) & own[1]).sum() / max((own[0] > t).sum(), 1) for t in bars]
            fine = [t for t, e in zip(bars, exact) if e >= _PRECISION]
            bar[k] = fine[0] if fine else bars[int(np.argmax(exact))]
    report = []
    score = x[held] @ w + b - bar
    for k, name in enumerate(CLASSES):
        said, true = score[:, k] > 0, y[held][:, k]
        hit = int((said & true).sum())
        report.append((name, int(clean.sum()), int(y[clean][:, k].sum()), len(score), int(true.sum()), hit / max(int(said.sum()), 1), hit / max(int(true.sum()), 1)))
    return Model(w, b, bar, report)


# ---- copies in other projects

SLOTS, BANDS, SHINGLE = 120, 20, 5
_SIMILAR = 0.8
_BLOCK, _FIRST = 512, 2
_BITS = 1 << 26


def _distinct_grams(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle of each text, ordered by both."""
    grams, at = found.grams(SHINGLE)
    text = found.text[at]
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    text, grams = text[order], grams[order]
    fresh = np.r_[True, (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])] if len(text) else np.zeros(0, bool)
    return text[fresh], grams[fresh]


def sketches(masked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of SLOTS 16-bit numbers, number of distinct shingles): one-permutation MinHash over shingles of five words."""
    signatures, count, _ = _sketched(masked)
    return signatures, count


def _sketched(masked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, numbers of distinct shingles, and a hash that texts of the same shingles share: of the set of
    shingles, or of all words where there are fewer than a shingle has; 0 for texts without a word."""
    found = words_of(*text_buffer(masked))
    n = len(masked)
    text, grams = _distinct_grams(found)
    count = np.bincount(text, minlength=n)[:n]
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, text, mix(grams * np.uint64(0x9E3779B97F4A7C15)))
    first = found.first_of()
    place = np.arange(len(found.hash)) - first[found.text]
    few = (count == 0)[found.text]
    np.add.at(whole, found.text[few], mix(found.hash[few] * np.uint64(0x9E3779B97F4A7C15) + place[few].astype(np.uint64) + np.uint64(1)))
    whole = np.where(np.diff(first) > 0, mix(whole + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1), np.uint64(0))
    slot = ((grams >> np.uint64(40)) * np.uint64(SLOTS) >> np.uint64(24)).astype(np.int64)
    low = (grams & np.uint64((1 << 40) - 1)).astype(np.int64)
    key = text * SLOTS + slot  # ascending, as the shingles of each text are
    least = np.full(n * SLOTS, -1, np.int64)
    if len(key):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least[key[start]] = np.minimum.reduceat(low, start)
    least = least.reshape(n, SLOTS)
    # an empty slot takes the value of the next filled one, mixed with the distance
    filled = least >= 0
    place = np.arange(2 * SLOTS)
    double = np.concatenate([filled, filled], 1)
    nxt = np.where(double, place, 4 * SLOTS)
    nxt = np.minimum.accumulate(nxt[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    far = np.where(nxt >= 4 * SLOTS, 0, nxt - place[:SLOTS])
    value = np.take_along_axis(least, np.minimum(nxt, 2 * SLOTS - 1) % SLOTS, 1)
    mixed = mix(value.astype(np.uint64) * np.uint64(2654435761) + far.astype(np.uint64))
    return (mixed & np.uint64(0xFFFF)).astype(np.uint16), count, whole


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """BANDS hashes of each signature."""
    per = SLOTS // BANDS
    out = np.zeros((len(signatures), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(signatures), np.uint64(b + 1))
        for k in range(per):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, b * per + k])
        out[:, b] = h
    return out.view(np.int64)


def _near(seek: np.ndarray, held: np.ndarray, n_seek: np.ndarray, n_held: np.ndarray) -> np.ndarray:
    """Share of equal slots of each pair, 0 where it lies four standard errors below the similarity sought; texts
    of few shingles have larger errors."""
    share = np.empty((len(seek), len(held)), np.float32)
    step = max(1, (8 << 20) // max(held.size, 1))
    for a in range(0, len(seek), step):
        share[a : a + step] = (seek[a : a + step, None, :] == held[None, :, :]).mean(2, dtype=np.float32)
    least = np.minimum(np.minimum(n_seek[:, None], n_held[None, :]), SLOTS)
    error = np.sqrt(_SIMILAR * (1 - _SIMILAR) / np.maximum(least, 1))
    return np.where(share >= _SIMILAR - 4 * error, share, 0)


def _candidates(first: int | None):
    """Over rows ordered by unit (unit, sid, own, seeks, held, n, sig): pairs of a unit that may be copies, for each
    seeking row the `first` nearest (None: all) of other projects, and whether there are more."""

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        sid, own, n = (group.column(k).to_numpy() for k in ("sid", "own", "n"))
        seeks, held = (np.flatnonzero(group.column(k).to_numpy()) for k in ("seeks", "held"))
        if not len(seeks) or not len(held):
            return
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
        for a in range(0, len(seeks), _BLOCK):
            some = seeks[a : a + _BLOCK]
            near = _near(sig[some], sig[held], n[some], n[held])
            near[(sid[some][:, None] == sid[held][None, :]) | (own[some][:, None] == own[held][None, :]) & (own[some][:, None] != 0)] = 0
            total = (near > 0).sum(1)
            if first is not None and near.shape[1] > first:
                bar = -np.partition(-near, first - 1, axis=1)[:, first - 1]
                near[near < bar[:, None]] = 0
                above, even = (near > bar[:, None]).sum(1), (near == bar[:, None]) & (near > 0)
                near[even & (np.cumsum(even, axis=1) > first - above[:, None])] = 0
            i, j = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(sid[some][i]), pa.array(sid[held][j]), pa.array(near[i, j]), pa.array(total[i] > (len(held) if first is None else first))], names=["sid", "other", "share", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the unit that the last batch did not end
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for a, b in zip(cuts, cuts[1:]):
                if kept and kept[-1].column(0)[0].as_py() != unit[a]:
                    yield from pairs(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from pairs(pa.Table.from_batches(kept))

    return run


def _shingled(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and shingles (distinct, ascending, 8 bytes each) of the wanted texts (sid, tid). The texts are read once
    more and not shuffled: what is sent to the tasks is a bit map of tid of fixed size."""

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for piece in np.unique(at >> 16):
                seen.setdefault(int(piece), np.zeros(1 << 16, bool))[at[at >> 16 == piece] & 0xFFFF] = True
        for piece, flags in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["piece", "bits"])

    places = wanted.select(F.expr(f"pmod(tid, {_BITS})").cast("long").alias("place")).repartition(F.expr("place div 65536"))
    bits = {r["piece"]: r["bits"] for r in places.mapInArrow(bits_of, "piece bigint, bits binary").toLocalIterator()}
    shared = files.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: np.unpackbits(np.frombuffer(v, np.uint8)).astype(bool) for k, v in shared.value.items()}
        for batch in (part for whole in batches for part in portions(whole, 1, 1 << 20)):
            at = batch.column(0).to_numpy() % _BITS
            hit = [i for i, p in enumerate(at.tolist()) if (flags := known.get(p >> 16)) is not None and flags[p & 0xFFFF]]
            if hit:
                own = batch.take(pa.array(hit))
                text, grams = _distinct_grams(words_of(*text_buffer(pa.array([rest for *_, rest in giveaways_of(own.column(1))], pa.large_string()))))
                edge = np.searchsorted(text, np.arange(len(hit) + 1))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([grams[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], names=["tid", "grams"])

    texts = files.where("content is not null").select(F.xxhash64("content").alias("tid"), "content").mapInArrow(run, "tid bigint, grams binary")
    return texts.join(wanted, "tid").groupBy("sid").agg(F.first("grams").alias("grams"))


def _same(pairs: DataFrame, one: DataFrame, files: DataFrame) -> DataFrame:
    """sid of both texts of every pair (sid, other) whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    pairs = pairs.select(F.least("sid", "other").alias("sid"), F.greatest("sid", "other").alias("other")).distinct()
    wanted = pairs.select(F.explode(F.array("sid", "other")).alias("sid")).distinct().join(one.select("sid", "tid"), "sid")
    grams = materialize(_shingled(files, materialize(wanted, "wanted")), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= _SIMILAR * max(len(x), len(y)) else 0
                keep.append(common > 0 and common * 5 >= 4 * (len(x) + len(y) - common))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(0), kept), pc.filter(batch.column(1), kept)], names=["sid", "other"])

    both = pairs.join(grams, "sid").join(grams.select(F.col("sid").alias("other"), F.col("grams").alias("grams2")), "other")
    same = both.select("sid", "other", "grams", "grams2").mapInArrow(verify, "sid bigint, other bigint")
    return same.select(F.explode(F.array("sid", "other")).alias("sid")).distinct()


def copied_sketches(sketched: DataFrame, files: DataFrame) -> DataFrame:
    """sid of every text that another project holds too, equal or at a Jaccard similarity of 0.8 or more of the shingles.

    sketched: root, sid, tid (the hash of the content), n (shingles), sig, bands; files: root, content. Texts of
    equal shingles are one row. The sketches only name candidates, those that share a band bucket with a
    row of another project and whose signatures are not four standard errors too far apart; the shingles
    of each decide. Every member of a bucket meets every other one unless it has met a copy: first
    blocks of a bucket are paired out and each member's nearest candidates verified, then the members
    without a copy meet the whole bucket, in units of bounded size. A null root is one project."""
    one = sketched.withColumn("root", F.coalesce("root", F.lit(""))).groupBy("sid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("tid").alias("tid"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    one = materialize(one, "sketches")
    rows = one.select("sid", "lo", "hi", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("lo").alias("a"), F.max("hi").alias("b")).where("size > 1 and a != b").select("band", F.ceil(F.col("size") / _BLOCK).alias("blocks"))
    met = rows.join(buckets, "band").select("band", "blocks", "sid", F.expr("pmod(xxhash64(sid, 7), blocks)").alias("block"))
    met = materialize(met, "buckets")
    # own is 0 where several projects hold the text: it has its copy, and any other text may be one of it
    held = one.select("sid", F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")).otherwise(0).alias("own"), "n", "sig")

    def paired(units: DataFrame, first: int | None) -> DataFrame:
        rows = units.join(held, "sid").select("unit", "sid", "own", (F.col("seeks") & (F.col("own") != 0)).alias("seeks"), "held", "n", "sig")
        return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_candidates(first), "sid bigint, other bigint, share float, more boolean")

    blocks = met.select(F.xxhash64("band", "block").alias("unit"), "sid", F.lit(True).alias("seeks"), F.lit(True).alias("held"))
    found = paired(blocks, _FIRST).groupBy("sid").agg(F.collect_set(F.struct("share", "other")).alias("all"), F.max("more").alias("more"))
    found = materialize(found.select("sid", F.expr(f"transform(slice(sort_array(all, false), 1, {_FIRST}), x -> x.other)").alias("others"), F.expr(f"more or size(all) > {_FIRST}").alias("more")), "near")
    done = one.where("lo != hi").select("sid").unionAll(_same(found.select("sid", F.explode("others").alias("other")), one, files)).distinct()
    done = materialize(done, "copied")
    left = met.where("blocks > 1").select("sid").unionAll(found.where("more").select("sid")).distinct().join(done, "sid", "left_anti")
    left = materialize(left, "left")
    if left.isEmpty():
        return done
    seek = met.join(left, "sid").select("band", "blocks", "sid", "block")
    wide = seek.select("band", "block").distinct().withColumnRenamed("block", "seek_block")
    units = seek.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("held_block"), "band", F.col("block").alias("seek_block"), "sid").select(F.xxhash64("band", "seek_block", "held_block").alias("unit"), "sid", F.lit(True).alias("seeks"), F.lit(False).alias("held"))
    units = units.unionAll(met.join(wide, "band").select(F.xxhash64("band", "seek_block", "block").alias("unit"), "sid", F.lit(False).alias("seeks"), F.lit(True).alias("held")))
    late = materialize(paired(units, None).select("sid", "other").distinct(), "rest")
    return done.unionAll(_same(late, one, files)).distinct()


# ---- the operator


def _siblings(structure: str | None, path: str, cache: dict) -> set[str]:
    if structure not in cache:
        if len(cache) > 64:
            cache.clear()
        cache[structure] = beside(structure)
    return cache[structure].get(path.rpartition("/")[0], set())


def fit(files: DataFrame, projects: DataFrame | None = None, *, train_repositories: int = 300, train_chars: int = 200_000, root_files: int = 200, train_files: int = 8_000, train_total: int = 50_000_000) -> Model:
    """Classifiers from the files of about train_repositories repositories (chosen by the hash of their root). projects
    (a column root) spares counting them in the files.

    The documented bound of what is learned from: no file longer than train_chars characters, of a repository
    at most root_files distinct files, at most train_files files and train_total characters in all. Where a bound is
    met, the files of the least hashes are taken; all that happens before anything reaches the driver."""
    roots = max(int((files if projects is None else projects).select("root").distinct().count()), 1)
    share = min(1.0, train_repositories / roots)
    picked = _sample(files.where(F.expr(f"pmod(xxhash64(root), 1000000) < {int(share * 1_000_000)} AND length(content) <= {train_chars:d}")), root_files, train_files, train_total)
    cache: dict = {}
    rows = [(r, f, c, _siblings(s, f, cache)) for r, f, c, s, _ in sorted(((r["root"], r["file"], r["content"], r["structure"], r["snapshot_id"]) for r in picked.toLocalIterator()), key=lambda t: (t[0], t[1], str(t[4]), t[2]))]
    return train(rows)


def _sample(files: DataFrame, root_files: int, train_files: int, train_total: int) -> DataFrame:
    """root, file, content, structure and snapshot_id of at most so many files; rows that are sent again count once.

    Files are ranked by hashes in tables without contents, whose rows are limited before they are shuffled; the
    contents are then picked by a join with the few names that remain."""
    files = files.select(F.coalesce("root", F.lit("")).alias("root"), F.coalesce("file", F.lit("")).alias("file"), "content", "structure", "snapshot_id").withColumn("key", F.xxhash64("root", "file", "content", "structure", "snapshot_id"))
    names = files.select("root", "key", F.length("content").alias("size"))
    own = names.withColumn("place", F.dense_rank().over(Window.partitionBy("root").orderBy("key"))).where(f"place <= {root_files:d}").groupBy("key").agg(F.first("size").alias("size"))
    few = own.orderBy("key").limit(train_files)
    total = F.sum("size").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("total", total).where(f"total <= {train_total:d}").select("key")
    return files.join(F.broadcast(few), "key", "left_semi").dropDuplicates(["key"]).drop("key")


def not_handwritten(files: DataFrame, model: Model) -> DataFrame:
    """One row for each file: its score (above 0: not written by hand here), the class, and what spoke for it.

    files: snapshot_id, root (the project), file, content, structure. The score is that of the
    strongest classifier over its bar, plus 2 (and without the bar) for a header, suffix or neighbour that names the class, plus 1 for a folder
    of third-party code, plus 2 for a copy in another project. Three to four passes over the texts (fit reads a sample; one or two read
    the shingles of candidate copies), whole texts, no text is shuffled: only sketches of 240 bytes,
    shingles of candidates and scores are. Returns snapshot_id, file, score, kind, svm_score, giveaway, copied.

    Defined results: null content gives no row; empty content scores by its path; equal rows are
    each reported; a null path counts as an empty one; a null structure names no neighbours; roots
    scanned several times are one project, so a file is no copy of itself.
    """
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.bar))
    schema = T.StructType([T.StructField("snapshot_id", files.schema["snapshot_id"].dataType), T.StructField("root", T.StringType()), T.StructField("file", T.StringType()), T.StructField("svm_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("giveaway", T.BooleanType()), T.StructField("sid", T.LongType()), T.StructField("tid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, bar = shared.value
        cache: dict = {}
        for batch in (part for whole in batches for part in portions(whole, 3, 1 << 20)):
            paths = [p or "" for p in batch.column(2).to_pylist()]
            given, masked = [], []
            for path, (tool, copy, rest), structure in zip(paths, giveaways_of(batch.column(3)), batch.column(4).to_pylist()):
                masked.append(rest)
                siblings = _siblings(structure, path, cache)
                given.append([tool or bool(_TOOL_FILE.search(path)) or bool(_TOOL_TEXT.search(rest)), bool(_MIN_FILE.search(path)), copy or ("/" in path and any(_COPY_BESIDE.match(s) for s in siblings)), False])
            text = pa.array(masked, pa.large_string())
            svm = features(text, paths) @ weights + bias - bar
            named = np.array(given, bool)
            folder = np.array([[0.0, 0.0, 1.0, 0.0] if _COPY_FOLDER & set(p.lower().split("/")[:-1]) else [0.0] * len(CLASSES) for p in paths])
            total = svm + (2.0 + bar) * named + folder
            best = total.argmax(1)
            signatures, count, whole = _sketched(text)
            bands = band_keys(signatures)
            # texts of fewer words than a shingle has are copies if equal; they are in no bucket
            per = np.where(count > 0, BANDS, 0)
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(bands[count > 0].ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array(svm.max(1).astype(np.float64)), pa.array(total.max(1).astype(np.float64)), pa.array([CLASSES[k] for k in best]), pa.array(named.any(1)),
                    pa.array(whole.view(np.int64), pa.int64(), mask=whole == 0), batch.column(5), pa.array(count.astype(np.int64)), pa.array([s.tobytes() for s in signatures], pa.binary()), flat,
                ],
                names=schema.names,
            )

    seen = files.select("snapshot_id", "root", "file", "content", "structure", F.xxhash64("content").alias("tid")).where("content is not null").mapInArrow(run, schema)
    seen = materialize(seen, "files")
    copies = copied_sketches(seen.where("sid is not null").select("root", "sid", "tid", "n", "sig", "bands"), files).withColumn("copied", F.lit(True))
    judged = seen.drop("tid", "n", "sig", "bands", "root").join(copies, "sid", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    score = F.col("score") + F.when(F.col("copied"), 2.0).otherwise(0.0)
    return judged.select("snapshot_id", "file", score.alias("score"), F.when(F.col("copied") & (F.col("score") <= 0), "vendored").otherwise(F.col("kind")).alias("kind"), "svm_score", "giveaway", "copied")
