"""Secret scans: fixed patterns, and strings in sensitive context that zstandard can't explain.

The base kinds (assign, access, hex) are found by their patterns, leftmost and without overlap within a kind. Besides,
each long token of mixed characters in the line of a sensitive word, on both sides of it, or in the next line, and in
the lines of a key block, is compressed with a dictionary made of the text
around it, without its own further copies, and of common identifiers; what it adds to the compressed size, per character, is its novelty. Tokens of
high novelty that no base span touches, and their copies anywhere in the text, are reported as ``novel``.

Null texts count as empty and have no spans. Equal texts have equal spans. Offsets are code points, ends exclusive.
Only the id and text columns are read."""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import documents, map_documents

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words of sensitive context, and identifiers and words that are no secrets.
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "session", "signature")
IDENTIFIERS = ("password passwd secret token apikey api_key access_key private_key client_secret authorization bearer basic credential session_id signature username user_name "
               "localhost example config default value string true false null none self this return function import public static void const class "
               "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ http https www com org net json xml yaml utf-8 base64 sha256 sha1 md5 rsa ssh-rsa").encode()
#: A token, or a value after '=' or ':', which may hold more signs; '=' only as padding at the end.
TOKEN = re.compile(r"""(?:(?<=[=:])\x20*["']?(?P<value>[A-Za-z0-9+/_~.!$%^*#-]{16,}PAD)|(?P<token>(?:[A-Za-z0-9+/_~.-]|%[0-9A-Fa-f]{2}){16,}PAD))""".replace("PAD", r"(?:={1,2}(?![A-Za-z0-9+/_=~.%-]))?"))
_CUE = re.compile("(?ai:" + "|".join(CUES) + ")")
_ARMOR = re.compile(r"-----(BEGIN|END)\b([^\n-]*)-----")
#: Lines of nothing but a token or its rest, without what wraps lines; pieces of a key's body.
_ALONE, _TAIL, _WRAP = re.compile(r"[A-Za-z0-9+/_~.-]{16,}={0,2}"), re.compile(r"=?[A-Za-z0-9+/]{1,15}={0,2}"), " \t\r\"'`>#*,;()\\+"
_HEADER = re.compile(r"\n|[A-Za-z-]+: ")
_PIECE = re.compile(r"\\[nrt]|(=?[A-Za-z0-9+/]+={0,2})")
#: A short last line below a line of a key, and the end of the block or none.
_REST = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/]+={0,2})[\x20\t\r]*(?:\n|$)[\x20\t]*(-----END)?")
_STATEMENT = re.compile(r"[\n;]|[.!?](?=\s)")
_CUE_BYTES = [c.encode() for c in CUES]
_ASSIGN_BYTES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
_HEX_MARK = bytes(48 if c in b"0123456789abcdef" else 32 for c in range(256))
NEAR, AROUND, NOVELTY = 48, 512, 0.8


def novelty(token: str, context: str) -> float:
    """Compressed bytes that ``token`` adds, per byte, when its context and common identifiers are known."""
    raw = token.encode("utf-8", "surrogatepass")
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + context.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(squeeze.compress(raw)) - len(squeeze.compress(b""))) / max(1, len(raw))


def _mixed(token: str) -> bool:
    """Whether a token has digits and letters, or letters of both cases beyond a leading capital."""
    digit = any("0" <= c <= "9" for c in token)
    lower = any("a" <= c <= "z" for c in token)
    upper = any("A" <= c <= "Z" for c in token[1:])
    return digit and (lower or upper) or lower and upper


def _blocks(text: str) -> list[tuple[int, int]]:
    """The bodies of armored blocks (BEGIN to END) whose label holds a cue."""
    marks = list(_ARMOR.finditer(text)) if "-----" in text else []
    return [(m.end(), n.start()) for m, n in zip(marks, marks[1:]) if m[1] == "BEGIN" and n[1] == "END" and _CUE.search(m[2])]


def _sensitive(text: str, cues: list[int], blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of whole lines, in order: the line of each cue, the next line with text (a value may follow its label),
    what ends up to NEAR behind the cue, armored blocks, and the token lines that go on from a line of one token."""
    lines, starts, at = text.split("\n"), [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    after, far = [0] * len(lines), len(lines) - 1
    for i in range(len(lines) - 1, -1, -1):
        after[i] = far
        far = i if lines[i].strip() else far
    of = lambda p: bisect_right(starts, p) - 1
    marked, upto = bytearray(len(lines)), -1
    for a, b in sorted([(of(c), max(after[of(c)], of(min(len(text), c + NEAR)))) for c in cues] + [(of(a), of(b)) for a, b in blocks]):
        for i in range(max(a, upto + 1), b + 1):
            marked[i] = 1
        upto = max(upto, b)
    lines = [line.strip(_WRAP) for line in lines]
    alone, tail = ([bool(p.fullmatch(line)) for line in lines] for p in (_ALONE, _TAIL))
    ends = [line.startswith("-----END") for line in lines]
    head = False  # between BEGIN and the first line of the body
    for i in range(1, len(lines)):
        head = marked[i - 1] and "-----BEGIN" in lines[i - 1] or head and bool(_HEADER.match(lines[i - 1] + "\n"))
        marked[i] |= head or marked[i - 1] and alone[i - 1] and alone[i]
    for i in range(len(lines) - 2, -1, -1):  # upwards: a block whose beginning isn't in the text
        marked[i] |= marked[i + 1] and (alone[i] and (alone[i + 1] or tail[i + 1] or ends[i + 1]) or tail[i] and ends[i + 1])
    out: list[tuple[int, int]] = []
    starts.append(at)
    for i in range(len(lines)):
        if marked[i]:
            if i and marked[i - 1]:
                out[-1] = (out[-1][0], starts[i + 1] - 1)
            else:
                out.append((starts[i], starts[i + 1] - 1))
    return out


class _Statements:
    """The statement of a place: its bounds, and whether a cue stands in it."""
    def __init__(self, text: str, cues: list[int]):
        self.text, self.cues, self.starts = text, cues, None

    def __call__(self, at: int) -> bool:
        if self.starts is None:
            self.starts = [0, *(m.end() for m in _STATEMENT.finditer(self.text)), len(self.text) + 1]
        k = bisect_right(self.starts, at)
        return bisect_right(self.cues, self.starts[k]) > bisect_right(self.cues, self.starts[k - 1])


def _core(token: str) -> str:
    """A token without what may be punctuation or padding around it."""
    return token.strip(".~=-") or token


def _copies(text: str, core: str, low: int, high: int):
    at = text.find(core, low, high)
    while at >= 0:
        yield at
        at = text.find(core, at + len(core), high)


def _context(text: str, a: int, b: int, cued: _Statements) -> str:
    """The characters around a candidate without further copies of it, which would explain a repeated secret by itself.

    Only a copy that its line first names in a statement without a cue, and then in one with a cue, remains: it is a
    name that the text explains."""
    core = _core(text[a:b])
    n = len(core)
    out = []
    for low, high in ((max(0, a - AROUND), a), (b, min(len(text), b + AROUND))):
        at = low
        for c in _copies(text, core, b if low == b else max(0, low - n), min(len(text), high + n) if low == b else a):
            first, second = sorted((a, c))
            if "\n" not in text[first:second] and not cued(first) and cued(second):
                continue
            out.append(text[at:max(at, c)])
            at = max(at, min(high, c + n))
        out.append(text[at:high])
    return " ".join(out)


def _novel(text: str, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of novel tokens in sensitive context that no base span touches."""
    cues = [m.end() for m in _CUE.finditer(text)]
    if not cues:
        return []
    taken = bytearray(len(text))
    found: set[tuple[int, int]] = set()
    free = lambda a, b: taken.find(1, a, b) < 0

    def take(a: int, b: int) -> None:
        found.add((a, b))
        taken[a:b] = b"\1" * (b - a)

    for a, b in base:
        taken[a:b] = b"\1" * (b - a)
    blocks, cued = _blocks(text), _Statements(text, cues)
    for low, high in _sensitive(text, cues, blocks):
        for t in TOKEN.finditer(text, low, high):
            a, b = t.span(t.lastgroup)
            if _mixed(text[a:b]) and free(a, b) and novelty(text[a:b], _context(text, a, b, cued)) >= NOVELTY:
                take(a, b)
    # further copies of what was found
    for core in sorted({_core(text[a:b]) for a, b in found}, key=lambda c: (-len(c), c)):
        for at in _copies(text, core, 0, len(text)):
            if free(at, at + len(core)):
                take(at, at + len(core))
    # what stands beside the novel lines of a key belongs to it: the rest of an armored body, and the short last line of a wrapped one
    for low, high in blocks:
        if any(low <= a < high for a, _ in found):
            body = [m.span(1) for m in _PIECE.finditer(text, low, high) if m[1]]
            first = next((i for i, (a, b) in enumerate(body) if b - a >= 16), len(body))
            for a, b in body[first:]:
                if free(a, b):
                    take(a, b)
    above = (0, 0)
    for a, b in sorted(found):
        rest = _REST.match(text, b)
        wrapped = above[1] - above[0] == b - a > 0 and text[above[1]:a].isspace()
        if rest and len(rest[1]) < min(16, b - a) and (rest[2] or wrapped) and free(*rest.span(1)):
            take(*rest.span(1))
        above = (a, b)
    return sorted(found)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind, end) in order."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found: list[tuple[int, int, int]] = []
    if any(w in low for w in _ASSIGN_BYTES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"0" * 32 in raw.translate(_HEX_MARK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in _CUE_BYTES):
        found += [(a, 3, b) for a, b in _novel(text, sorted((a, b) for a, _, b in found))]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every stretch covered by spans replaced by ``mark``; null stays null."""
    spans = scan(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a > end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(block: pa.RecordBatch) -> dict:
        out: dict = {doc_id: block.column(0), **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for t in block.column(1).to_pylist():
            spans = scan(t)
            for n, k in enumerate(KINDS):
                out[f"n_{k}"].append(sum(s[1] == n for s in spans))
            out["base_sha256"].append(hashlib.sha256(written([s for s in spans if s[1] < 3]).encode()).hexdigest())
            out["spans"].append(written(spans))
        return out
    return map_documents(documents(docs, doc_id, text), text, f"`{doc_id}` {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string", run)
