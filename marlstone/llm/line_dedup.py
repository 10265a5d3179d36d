"""Line deduplication over overlapping windows of three lines.

A line ends at a newline, at a full stop, exclamation or question mark before a
space, or at an ideographic full stop, exclamation or question mark.  A line of
more than ``LONG`` words is cut further behind words whose hash is smaller than
those of the ``RADIUS`` words on each side, so that a passage that starts and
ends inside long sentences has whole lines too: the cuts depend on the words
around them only, and a line made by them has more than ``RADIUS`` words.
Stretches without a word belong to the line before.  Three consecutive lines,
lower-cased and with single spaces, make a window; a text of fewer lines is one
window.  Every window is looked at, however short its lines.  The first
occurrence of a window in the corpus (by document id, nulls last, then by row
and place) stays; the lines of every later one are covered, covered stretches
are merged, and the covered lines are removed.

Each task keeps one entry per distinct window of its chunk, so a window that is
in a third of all documents reaches the merging task once per chunk; later
occurrences inside a chunk are settled there.  Only texts that lose lines meet
their spans in a shuffle; the others pass by.

Defined results: null texts stay null; texts without words stay as they are;
an occurrence that overlaps the first one in its own text loses only the lines
behind it; repeated rows lose what the first of them keeps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import common

WINDOW = 3
#: Words of the longest line that is not cut further, and words on each side that a cut looks at.
LONG, RADIUS = 10, 3
#: Windows of a chunk, and documents whose windows meet in one merging task on average.
CHUNK, DOCS_PER_PART = 1_000_000, 4_096
#: Spans settled in a chunk that travel together.
SETTLED = 8_192
#: Rows with spans whose ids may be broadcast (8 bytes each); beyond, every text is shuffled.
BROADCAST_KEYS = 2_000_000
#: Marks the ends of lines; a text that holds it is cut by the slower way.
MARK = "\U0010ffff"
WIDE_ENDS = "\u3002\uff01\uff1f"
WORD = re.compile(r"\S+")
#: White space and line ends of ASCII by byte; other white space; base of word hashes.
SPACE, END = (np.isin(np.arange(256), x) for x in ([9, 10, 11, 12, 13, 28, 29, 30, 31, 32], [33, 46, 63]))
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BASE = np.uint64(0x9E3779B97F4A7C55)
#: Bytes of text whose windows are made at once.
AT_ONCE = 1_000_000
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))

REQUESTS = "part int, base bigint, h1 binary, h2 binary, doc binary, row binary, pos binary, size binary, settled boolean"
SPANS = "rid bigint, spans binary"


def pieces(text: str) -> list[str]:
    """The text cut behind each natural line end; joined they are the text."""
    if MARK in text:
        out, own = [], ""
        for k, c in enumerate(text):
            own += c
            if c == "\n" or c in WIDE_ENDS or (c == " " and k and text[k - 1] in ".!?"):
                out.append(own)
                own = ""
        return [*out, own]
    for end in ("\n", ". ", "! ", "? ", *(() if text.isascii() else WIDE_ENDS)):
        text = text.replace(end, end + MARK)
    return text.split(MARK)


def plain(text: str) -> bytes:
    """The lower-cased text in which every white space is ASCII, of the same width, as words and natural ends need it."""
    low = text.lower()
    return (low if low.isascii() else WIDE_SPACE.sub(lambda m: " " * len(m[0].encode()), low)).encode("utf-8", "surrogatepass")


class Widths(dict):
    """Whether the lower case of a character has another width."""

    def __missing__(self, c: str) -> bool:
        out = self[c] = len(c.lower().encode("utf-8", "surrogatepass")) != len(c.encode("utf-8", "surrogatepass"))
        return out


_widths = common.cache("line_dedup", Widths())


def aligned(text: str) -> bool:
    """Whether places in :func:`plain` are places in the text's own bytes."""
    return text.isascii() or not any(map(_widths.__getitem__, set(text)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of word hashes and of its inverse, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)]) for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and natural line of each word of a text (of :func:`plain`) given as bytes, and the begin of each natural line but the first.

    A word's hash is the sum of its bytes times the powers of ``BASE``, mixed; it
    is the difference of two running sums, shifted back to the word's start.
    """
    space = SPACE[data]
    cut = data == 10
    cut[1:] |= (data[1:] == 32) & END[data[:-1]]
    if len(data) > 2 and (data > 127).any():
        triple = data[:-2].astype(np.int64) << 16 | data[1:-1].astype(np.int64) << 8 | data[2:]
        cut[2:] |= (triple == 0xE38082) | (triple == 0xEFBC81) | (triple == 0xEFBC9F)
    opens, closes = ~space, ~space
    opens[1:] &= space[:-1] | cut[:-1]
    closes[:-1] &= space[1:] | cut[:-1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    power, inverse = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.cumsum(data * power, dtype=np.uint64)
        before = np.where(first > 0, sums[first - 1], np.uint64(0))
        h = common.mix64((sums[last] - before) * inverse[first])
    begins = np.flatnonzero(cut) + 1
    return h, first, np.searchsorted(begins, first, "right"), begins


def cut_lines(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The number of words before each line's end: natural lines, and long ones cut behind locally smallest hashes."""
    ends = np.append(np.flatnonzero(line[1:] != line[:-1]) + 1, len(h))
    span = 2 * RADIUS + 1
    if len(h) <= span:
        return ends
    least = np.ones(len(h) - span, bool)
    own = h[RADIUS : RADIUS + len(least)]
    for k in range(span):
        if k != RADIUS:
            least &= own < h[k : k + len(least)]
    # the words it looks at, and as many on both sides of the cut, are of one line
    least &= line[: len(least)] == line[span : span + len(least)]
    at = np.flatnonzero(least) + RADIUS
    sizes = np.diff(ends, prepend=0)
    at = at[sizes[np.searchsorted(ends, at, "right")] > LONG]
    return np.sort(np.concatenate([ends, at + 1]))


def lines(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces that joined are the text, the line each piece belongs to (-1 before the first), and the words of each line."""
    natural = pieces(text)
    data = np.frombuffer(plain(text), np.uint8)
    h, _, of, _ = word_hashes(data) if len(data) else (np.empty(0, np.uint64), None, np.empty(0, np.int64), None)
    ends = cut_lines(h, of) if len(h) else np.empty(0, np.int64)
    out, line, at, done = [], [], 0, 0
    for piece in natural:
        n = len(piece.split())
        begin = 0
        stop = np.searchsorted(ends, at + n) if n else done
        if n and stop > done:
            starts = [m.start() for m in WORD.finditer(piece)]
            for k in range(done, stop):
                cut = starts[int(ends[k]) - at]
                out.append(piece[begin:cut])
                line.append(k)
                begin = cut
        out.append(piece[begin:])
        line.append(stop if n else done - 1)
        at, done = at + n, stop + 1 if n else done
    return out, np.array(line, np.int64), np.diff(ends, prepend=0)


class Layout:
    """The lines of some texts (of :func:`plain`): text, place in it, first byte, words."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        none = np.empty(0, np.int64)
        self.hashes, first, line, begins = word_hashes(data) if len(data) else (np.empty(0, np.uint64), none, none, none)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.ends = cut_lines(self.hashes, line) if len(first) else none
        self.begin = np.concatenate([none, [0], self.ends[:-1]])[: len(self.ends)]
        self.text = np.searchsorted(self.starts, first[self.begin], "right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        self.top = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.ends)) - self.top[self.text]
        # a natural line begins behind the end of the one before, any other with its first word
        natural = np.ones(len(self.ends), bool)
        natural[1:] = line[self.begin[1:]] != line[self.begin[1:] - 1]
        piece = np.concatenate([[0], begins])[np.searchsorted(begins, first[self.begin], "right")]
        self.bytes = np.where(natural, np.maximum(piece, self.starts[self.text]), first[self.begin])
        self.words = self.ends - self.begin

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes, number of the text, first line and end line of each window: three lines of one text, or all lines of a shorter one."""
        if not len(self.ends):
            return (np.empty(0, np.uint64), np.empty(0, np.uint32), *[np.empty(0, np.int64)] * 3)
        full = np.flatnonzero(self.text[WINDOW - 1 :] == self.text[: max(0, len(self.text) - WINDOW + 1)])
        few = np.flatnonzero((self.counts > 0) & (self.counts < WINDOW))
        at, n = np.concatenate([full, self.top[few]]), np.concatenate([np.full(len(full), WINDOW), self.counts[few]])
        with np.errstate(over="ignore"):
            nth = (np.arange(len(self.hashes)) - np.repeat(self.begin, self.words) + 1).astype(np.uint64)
            h = np.add.reduceat(common.mix64(self.hashes + nth * np.uint64(0x9E3779B97F4A7C15)), self.begin)
            one, two = n.astype(np.uint64), n.astype(np.uint64)
            for k in range(WINDOW):
                own = h[np.minimum(at + k, len(h) - 1)]
                has = k < n
                one = np.where(has, common.mix64(one * np.uint64(0x9E3779B97F4A7C15) + own), one)
                two = np.where(has, common.mix64(two * np.uint64(0xC2B2AE3D27D4EB4F) + (own ^ np.uint64(0xA0761D6478BD642F))), two)
        return one, (two >> np.uint64(32)).astype(np.uint32), self.text[at], self.place[at], self.place[at] + n

    def without(self, k: int, gone: np.ndarray, text: bytes) -> bytes:
        """The bytes of text ``k`` without the lines that are ``gone``."""
        own = slice(self.top[k], self.top[k] + self.counts[k])
        bounds = np.append(self.bytes[own] - self.starts[k], len(text)).tolist()
        kept = np.flatnonzero(~gone).tolist()
        return b"".join([text[: bounds[0]], *(text[bounds[j] : bounds[j + 1]] for j in kept)])


def packed(values: np.ndarray, dtype: str) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = values.astype(dtype).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def requests(rows: DataFrame, parts: int) -> DataFrame:
    """Per chunk and part: the first occurrences that may be later ones elsewhere, and the spans settled already."""

    def flush(base: int, held: list) -> pa.RecordBatch:
        h1, h2, doc, row, pos, end = (np.concatenate([x[k] for x in held]) for k in range(6))
        order = np.lexsort((pos, row, doc, h2, h1))
        h1, h2, doc, row, pos, end = (x[order] for x in (h1, h2, doc, row, pos, end))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = np.flatnonzero(~new)
        same = (row[again] == row[lead[again]]) & (doc[again] == doc[lead[again]])
        begin = np.where(same, np.maximum(pos[again], end[lead[again]]), pos[again])
        out = []
        keep = begin < end[again]
        rows_, begins, ends = row[again][keep], begin[keep].astype(np.uint32), end[again][keep]
        for k in range(0, len(rows_), SETTLED):  # small pieces, so that no part gets the spans of many chunks
            own = slice(k, k + SETTLED)
            out.append((int(common.mix64(np.array([base + k], np.uint64))[0] % np.uint64(parts)), base, b"", b"", b"", packed(rows_[own], "<u4"), packed(begins[own], "<u4"), packed(ends[own] - begins[own], "<u4"), True))
        first = np.flatnonzero(new)
        part = (h1[first] % np.uint64(parts)).astype(np.int64)
        first = first[np.argsort(part, kind="stable")]
        sizes = np.bincount(part, minlength=parts)
        at = 0
        for p in np.flatnonzero(sizes).tolist():
            own = first[at : at + sizes[p]]
            at += sizes[p]
            out.append((p, base, h1[own].tobytes(), h2[own].tobytes(), packed(doc[own], "<i8"), packed(row[own], "<u4"), packed(pos[own], "<u4"), packed(end[own] - pos[own], "<u1"), False))
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["part", "base", "h1", "h2", "doc", "row", "pos", "size", "settled"])

    @common.task("line_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held = 0, 0, []
        for whole in common.small_batches(batches, "text", AT_ONCE):
            every = whole.column("rid").to_numpy().astype(np.int64) >> 32
            cuts = [0, *(np.flatnonzero(np.diff(every)) + 1).tolist(), whole.num_rows]
            for batch in (whole.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False)):  # rows of one file, whose ids are near
                texts = [plain(t or "") for t in batch.column("text").to_pylist()]
                rids = batch.column("rid").to_numpy().astype(np.int64)
                docs = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)
                if held and (n >= CHUNK or rids.min() < base or rids.max() - base >= 1 << 32):
                    yield flush(base, held)
                    n, held = 0, []
                if not held:
                    base = int(rids.min())
                h1, h2, text, pos, end = Layout(texts).windows()
                if len(h1):
                    held.append((h1, h2, docs[text], (rids[text] - base).astype(np.uint32), pos.astype(np.uint32), end.astype(np.uint32)))
                    n += len(h1)
        if held:
            yield flush(base, held)

    return rows.mapInArrow(run, REQUESTS)


def by_row(rid: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    order = np.argsort(rid, kind="stable")
    rid, both = rid[order], np.stack([begin, end], axis=1).astype("<u4")[order]
    cuts = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(rid))
    return pa.table({"rid": pa.array(rid[cuts], pa.int64()), "spans": pa.array([both[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)] if len(rid) else [], pa.binary())})


def later_spans(asked: DataFrame) -> DataFrame:
    """Spans of lines that repeat an earlier window, by row; a row may come from several parts."""

    @common.group("line_dedup")
    def merge(table: pa.Table) -> pa.Table:
        columns: dict[str, list[np.ndarray]] = {k: [] for k in ("h1", "h2", "doc", "rid", "pos", "end")}
        rids, begins, ends = [], [], []
        for x in table.to_pylist():
            rid, pos = unpacked(x["row"], "<u4").astype(np.int64) + x["base"], unpacked(x["pos"], "<u4")
            end = pos + unpacked(x["size"], "<u4" if x["settled"] else "<u1")
            if x["settled"]:
                rids.append(rid), begins.append(pos), ends.append(end)
            else:
                for k, v in (("h1", np.frombuffer(x["h1"], np.uint64)), ("h2", np.frombuffer(x["h2"], np.uint32)), ("doc", unpacked(x["doc"], "<i8")), ("rid", rid), ("pos", pos), ("end", end)):
                    columns[k].append(v)
        if columns["h1"]:
            h1, h2, doc, rid, pos, end = (np.concatenate(v) for v in columns.values())
            order = np.lexsort((pos, rid, doc, h2, h1))
            h1, h2 = h1[order], h2[order]
            later = np.zeros(len(h1), bool)
            later[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            own = order[later]
            rids.append(rid[own]), begins.append(pos[own]), ends.append(end[own])
        if not rids:
            return by_row(np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32))
        return by_row(np.concatenate(rids), np.concatenate(begins), np.concatenate(ends))

    return asked.groupBy("part").applyInArrow(merge, SPANS)


def covered(spans: list[bytes], n: int) -> np.ndarray:
    """Which of ``n`` lines lie in a span."""
    delta = np.zeros(n + 1, np.int64)
    for data in spans:
        both = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(delta, both[:, 0], 1)
        np.add.at(delta, both[:, 1], -1)
    return np.cumsum(delta)[:-1] > 0


def without(texts: list[str | None], spans: list[list[bytes] | None]) -> Iterator[tuple[str | None, int, int, int]]:
    """Each text without the covered lines; its lines, the lines and the words removed."""
    own = Layout([plain(t or "") for t in texts])
    for k, (text, found) in enumerate(zip(texts, spans, strict=True)):
        n = int(own.counts[k])
        if text is None or not found:
            yield text, n, 0, 0
            continue
        gone = covered(found, n)
        if aligned(text):
            kept = own.without(k, gone, text.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")
        else:
            kept = "".join([p for p, j in zip(*lines(text)[:2], strict=True) if j < 0 or not gone[j]])
        yield kept, n, int(gone.sum()), int(own.words[own.top[k] : own.top[k] + n][gone].sum())


def dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``__m_row`` with its new text and counts (``kept``, ``n_lines``, ``n_removed``, ``words_removed``)."""
    rid, row = common.P + "rid", common.P + "row"
    rows = common.with_row_id(docs, "lines")
    text = F.col(f"{row}.text").cast("string").alias("text")
    n = rows.count()
    parts = max(64, -(-n // DOCS_PER_PART))
    asked = requests(rows.select(F.col(rid).alias("rid"), F.col(f"{row}.doc_id").cast("bigint").alias("doc_id"), text), parts)
    spans = common.materialise(later_spans(asked), "spans").groupBy("rid").agg(F.collect_list("spans").alias("spans"))
    hit = common.materialise(spans.select(F.col("rid").alias(rid)), "repeats", parts=common.files_for(n, 8))
    plain = [row, F.lit(None).cast("array<binary>").alias("spans"), text]
    if hit.count() <= BROADCAST_KEYS:
        touched = rows.join(F.broadcast(hit), rid, "left_semi")
        joined = touched.join(spans, touched[rid] == spans["rid"]).select(row, "spans", text).union(rows.join(F.broadcast(hit), rid, "left_anti").select(*plain))
    else:
        joined = rows.join(spans, rows[rid] == spans["rid"], "left").select(row, "spans", text)
    schema = T.StructType([rows.schema[row], *[T.StructField(n, t) for n, t in (("kept", T.StringType()), ("n_lines", T.LongType()), ("n_removed", T.LongType()), ("words_removed", T.LongType()))]])

    @common.task("line_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, "text", AT_ONCE):
            out = list(without(batch.column("text").to_pylist(), batch.column("spans").to_pylist()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3), strict=True)]], names=[row, "kept", "n_lines", "n_removed", "words_removed"])

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed``, ``words_removed`` and the remaining ``text``."""
    return dedup(docs).select(F.col(f"{common.P}row.doc_id").alias("doc_id"), "n_lines", "n_removed", "words_removed", F.col("kept").alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining texts; rows of which nothing remains go, all columns stay (``n_chars`` follows the text)."""
    row = common.P + "row"
    new = dedup(docs).filter("n_removed = 0 or kept rlike '\\\\S'")
    fixed = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col(f"{row}.n_chars")).otherwise(F.length("kept").cast("bigint")) if "n_chars" in docs.columns else None}
    return new.select(*[fixed[c].cast(docs.schema[c].dataType).alias(c) if fixed.get(c) is not None else F.col(row)[c].alias(c) for c in docs.columns])
