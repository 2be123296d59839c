"""SentencePiece encoding and decoding by best total score, giant documents by a max-plus scan.

Vocabulary, byte pieces and the dummy prefix come from a public SentencePiece model file.  A text's
encoding is the segmentation into pieces with the greatest sum of piece scores (the unigram objective); of
equally good ones the one whose last piece that differs is the longer.  Scores are multiples of 1/1024, so that sums are exact and don't
depend on their order.  A model of the unigram type has its own scores.  Where it is of the BPE type, its merge ranks r give scores
-log(r + 10) - PIECE; BPE ids made by greedy merges may differ, but ``decode``
reads these as well.  Characters without a piece, and the space mark itself, are spelled in byte pieces,
so decoding restores every text exactly.

No piece used here holds a space mark but at its start, or a line feed, so words are independent.  Words are searched by the
library in packs whose single-precision sums are exact too (some 600 characters); longer words here.  A
document over ``giant`` characters is split into chunks wherever they end.  The state at a
boundary is by how many characters the piece before it reaches over it.

1. A chunk's transfer matrix holds the best score from each state to each state.  Matrices are combined
   by max-plus products (an associative scan), which gives at each boundary the best score of each state.
2. With these, each chunk by itself maps every state at its end to the state where the best path to there comes in.
   The maps, followed from the document's end, give the state at each boundary.
3. Each chunk is traced back by itself.

So the result is the same whatever ``giant`` and ``chunk`` are.

A null text gives null ids (null ids decode to null), an empty text none; very long texts are encoded whole; rows are judged
one by one, repeated rows give repeated results; an empty table gives an empty result;
other columns pass through, whatever their names, except that ``ids`` (``text`` when
decoding) is replaced.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import bytehash as bh
from pageloom.llm.store import Workspace

SPACE = "▁"
EXACT = 1 << 14  # single-precision sums of multiples of 1 / UNIT are exact below this
NONE = -(1 << 60)  # below any sum of scores
UNIT = 1 << 10
#: What each piece costs beside its rank, for merge ranks.
PIECE = 4.0


class Pieces:
    """A vocabulary with integer scores, and best-score segmentation of words and chunks."""

    def __init__(self, scored: dict[str, tuple[int, int]], byte_ids: list[int], spelled: list[bytes], library=None):
        """scored: piece -> (score, id); byte_ids: of the 256 byte pieces; spelled: what each id decodes to.

        library: an encoder by the same scores (results don't need it).
        """
        self.scored, self.byte_ids, self.spelled, self.library = scored, byte_ids, spelled, library
        self.reach = max(map(len, scored), default=1)
        self.begun = {q[:i] for q in scored for i in range(1, len(q) + 1)}
        self.byte_score = min((s for s, _ in scored.values()), default=0) - 10 * UNIT  # as the library has it
        self.pack = EXACT * UNIT // -self.byte_score - 2

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        raw = {i: sp.get_score(i) for i in range(n)}
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = all(float(raw[i]).is_integer() for i in normal)  # merge ranks, not log probabilities
        scored, spelled = {}, [b""] * n
        for i in normal:
            p = sp.id_to_piece(i)
            spelled[i] = p.replace(SPACE, " ").encode()
            score = max(raw[i], -float(n))  # a model may rule pieces out by a huge penalty; the bare mark must stay
            if SPACE not in p[1:] and "\n" not in p and (score == raw[i] or p == SPACE):
                scored[p] = (round((-math.log(10 - score) - PIECE if ranked else score) * UNIT), i)
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(byte_ids):
            spelled[i] = bytes([b])
        scores = {i: s / UNIT for s, i in scored.values()}
        library = sentencepiece.SentencePieceProcessor(model_proto=unigram(model, {i: scores.get(i) for i in normal}))
        return cls(scored, byte_ids, spelled, library)

    def spelt(self, c: str) -> tuple[int, tuple[int, ...]]:
        """(score, ids) of a character in byte pieces."""
        b = (SPACE if c == LITERAL else c).encode()
        return self.byte_score, tuple(self.byte_ids[x] for x in b)

    def forward(self, u: str, n: int, begin: list[int | None]) -> list[tuple[int, int, tuple[int, ...]] | None]:
        """For each place the best (score, start of the last piece, its ids) of paths whose pieces start before n.

        begin: the scores with which paths come in at the first places (None: none does); their start is -1.  Of equal sums
        the longest last piece is taken.
        """
        scored, begun = self.scored.get, self.begun
        size = len(u)
        best: list = [None] * (size + 1)
        for i, s in enumerate(begin[: size + 1]):
            if s is not None:
                best[i] = (s, -1, ())
        for i in range(n):
            if (b := best[i]) is None:
                continue
            so_far, j, part = b[0], i + 1, u[i]
            if part not in begun or scored(part) is None:
                s, ids = self.spelt(part)
                if (o := best[j]) is None or so_far + s > o[0]:
                    best[j] = (so_far + s, i, ids)
            while part in begun:
                if (s := scored(part)) is not None and ((o := best[j]) is None or so_far + s[0] > o[0]):
                    best[j] = (so_far + s[0], i, (s[1],))
                if j == size:
                    break
                j += 1
                part = u[i:j]
        return best

    @staticmethod
    def back(best: list, end: int) -> tuple[int, bytes]:
        """The place where the path to ``end`` comes in, and its ids (int32)."""
        parts = []
        while best[end][1] >= 0:
            parts.append(best[end][2])
            end = best[end][1]
        return end, array("i", [x for p in reversed(parts) for x in p]).tobytes()

    def plain(self, u: str) -> bytes:
        """ids (int32) of a marked text that starts at a forced cut, searched here."""
        return b"".join([self.back(self.forward(w, len(w), [0]), len(w))[1] for w in cuts(u)])

    def searched(self, parts: list[str]) -> list[bytes]:
        """ids (int32) of texts that start at forced cuts (their spaces unmarked): by the library in packs whose sums are exact."""
        packs, of = [], []
        out: list[list[bytes]] = [[] for _ in parts]
        for k, u in enumerate(parts):
            for x in packed(u, self.pack):
                if self.library is not None and len(x) <= self.pack and SPACE not in x:
                    # The library puts a space mark before each text; behind a line feed, which is always spelled, the pack stands without it.
                    packs.append("\n" + x)
                    of.append((k, len(out[k])))
                    out[k].append(b"")
                else:
                    out[k].append(self.plain(marked(x)))
        for (k, i), ids in zip(of, self.library.encode(packs, num_threads=1) if packs else [], strict=True):
            out[k][i] = array("i", ids).tobytes()[8:]
        return [b"".join(x) for x in out]

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """ids (int32) of each whole text."""
        found = iter(self.searched([" " + t for t in texts if t]))  # (the blank is the dummy prefix)
        return [None if t is None else next(found) if t else b"" for t in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    # The parts of the scan.  A chunk is a marked text and, behind its n characters, the ones that a piece may reach into.

    def matrix(self, u: str, n: int) -> np.ndarray:
        """[i, j]: best score of pieces that start in the chunk, from coming in i characters in to reaching j beyond it."""
        m = self.reach
        out = np.full((m, m), NONE, np.int64)
        cut = [i for i in range(n) if forced(u, i)]
        if not cut:
            for i in range(min(m, len(u) + 1)):
                best = self.forward(u, n, [None] * i + [0])
                for j in range(min(m, len(u) - n + 1)):
                    if best[n + j] is not None:
                        out[i, j] = best[n + j][0]
            return out
        # Every path passes the first and the last forced cut: heads, a middle and tails add up.
        first, last = cut[0], cut[-1]
        middle = sum(self.forward(w, len(w), [0])[len(w)][0] for w in cuts(u[first:last]))
        tail = self.forward(u[last:], n - last, [0])
        for i in range(min(m, first + 1)):
            if (head := self.forward(u[:first], first, [None] * i + [0])[first]) is not None:
                for j in range(min(m, len(u) - n + 1)):
                    if (t := tail[n - last + j]) is not None:
                        out[i, j] = head[0] + middle + t[0]
        return out

    @staticmethod
    def begin(v: np.ndarray) -> list[int | None]:
        return [None if x <= NONE // 2 else int(x) for x in v]

    def enters(self, u: str, n: int, v: np.ndarray) -> np.ndarray:
        """For each state at the end, the state at which the best path to it comes in (-1: none); v: the best score of each state at the start."""
        out = np.full(self.reach, -1, np.int64)
        cut = [i for i in range(n) if forced(u, i)]
        first, last = (cut[0], cut[-1]) if cut else (0, 0)
        head = self.forward(u[:first], first, self.begin(v)) if cut else None
        best = self.forward(u[last:], n - last, [0] if cut else self.begin(v))
        for j in range(min(self.reach, len(u) - n + 1)):
            if best[n - last + j] is not None:
                out[j] = self.back(head, first)[0] if cut else self.back(best, n + j)[0]
        return out

    def trace(self, u: str, n: int, j: int, v: np.ndarray) -> bytes:
        """ids of a chunk on the best path to a state at its end."""
        cut = [k for k in range(n) if forced(u, k)]
        if not cut:
            return self.back(self.forward(u, n, self.begin(v)), n + j)[1]
        first, last = cut[0], cut[-1]
        head = self.back(self.forward(u[:first], first, self.begin(v)), first)[1]
        return head + self.searched([unmarked(u[first:last])])[0] + self.back(self.forward(u[last:], n - last, [0]), n - last + j)[1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:] if ids else ""


def _number(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return x, i


def _coded(x: int) -> bytes:
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def _fields(b: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(number, from, value from, to) of each field of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, v = _number(b, i)
        kind = key & 7
        if kind == 2:
            n, v = _number(b, v)
            end = v + n
        else:
            end = v + {1: 8, 5: 4}[kind] if kind else _number(b, v)[1]
        yield key >> 3, i, v, end
        i = end


def unigram(model: bytes, scores: dict[int, float | None]) -> bytes:
    """A SentencePiece model of the unigram type with these scores; pieces without one go unused.

    In the public format, field 1 of a model is a piece (2: score, 3: type, where 5 is unused), field 2 the trainer's
    settings (3: the model's type, where 1 is unigram).
    """
    out, k = [], -1
    for number, i, v, end in _fields(model):
        part = model[v:end]
        if number == 1:
            k += 1
            if k in scores:
                kept = b"".join(part[a:e] for f, a, _, e in _fields(part) if f not in (2, 3))
                s = scores[k]
                part = kept + (b"\x15" + struct.pack("<f", s) if s is not None else b"\x15" + struct.pack("<f", 0.0) + b"\x18\x05")
        elif number == 2:
            part = b"".join(part[a:e] for f, a, _, e in _fields(part) if f != 3) + b"\x18\x01"
        out.append(model[i:end] if number not in (1, 2) else _coded(number << 3 | 2) + _coded(len(part)) + part)
    return b"".join(out)


#: Stands for a space mark that the text itself holds (no text holds a lone surrogate).
LITERAL = "\ud800"
#: Stands between words for a moment (likewise).
CUT = "\ud801"


def marked(text: str) -> str:
    """The text with spaces marked, and marks of its own set apart."""
    return (text.replace(SPACE, LITERAL) if SPACE in text else text).replace(" ", SPACE)


def unmarked(u: str) -> str:
    u = u.replace(SPACE, " ")
    return u.replace(LITERAL, SPACE) if LITERAL in u else u


def packed(u: str, size: int) -> list[str]:
    """u in parts of up to ``size`` characters that start at forced cuts; a part without such a cut stays longer."""
    out, i = [], 0
    while i < len(u):
        j = len(u)
        if j - i > size:
            j = max(u.rfind(" ", i + 1, i + size + 1), u.rfind("\n", i + 1, i + size + 1))
            if j < 0:
                j = min((x for x in (u.find(" ", i + size), u.find("\n", i + size)) if x >= 0), default=len(u))
        out.append(u[i:j])
        i = j
    return out


def forced(u: str, i: int) -> bool:
    """Whether every path has a piece that starts here (a line feed is spelled in bytes, what follows it starts anew)."""
    return u[i] == SPACE or u[i] == "\n" or i > 0 and u[i - 1] == "\n"


def cuts(u: str) -> list[str]:
    """u between forced cuts."""
    parts = u.replace("\n", f"{CUT}\n{CUT}").replace(SPACE, CUT + SPACE).split(CUT) if "\n" in u else u.replace(SPACE, CUT + SPACE).split(CUT)
    return [p for p in parts if p]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product (associative)."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(out < NONE // 2, NONE, out)


def arrived(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Before each chunk, the best score of each state (the document starts in state 0).

    A prefix scan by doubling gives the product of all matrices up to each boundary.
    """
    scan, step = list(matrices), 1
    while step < len(scan):
        scan = [times(scan[i - step], scan[i]) if i >= step else scan[i] for i in range(len(scan))]
        step *= 2
    start = np.full(len(matrices[0]), NONE, np.int64)
    start[0] = 0
    return [start, *(m[0] for m in scan[:-1])]


def followed(maps: list[np.ndarray]) -> list[int]:
    """The state at the end of each chunk (0 at the document's end)."""
    out = [0]
    for m in maps[:0:-1]:
        out.append(int(m[out[-1]]))
    return out[::-1]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """Kept by a worker process."""
    return Pieces.from_file(path)


def _lists(parts: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(p) // 4 if p is not None else 0 for p in parts], np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p for p in parts if p is not None), np.int32))
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def _with(df: DataFrame, name: str, kind: T.DataType, drop: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema if f.name not in (name, *drop)), T.StructField(name, kind, True)])


def encode(docs: DataFrame, model: str, giant: int = 1 << 16, chunk: int = 1 << 14) -> DataFrame:
    """docs with ids array<int>; model: the path of a SentencePiece model on every machine."""
    size = F.coalesce(F.length("text"), F.lit(0))
    at = docs.columns.index("text")
    schema = _with(docs, "ids", T.ArrayType(T.IntegerType()))
    keep = [i for i, c in enumerate(docs.columns) if c != "ids"]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in bh.tidy(batches):
            for i, j in bh.pieces(bh.text_buffers(b.column(at))[1], 1 << 18):
                s = b.slice(i, j - i)
                ids = _lists(p.encode_all(s.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(s.column(k) for k in keep), ids], names=schema.names)

    return docs.filter(size <= giant).mapInArrow(small, schema).unionByName(_giants(docs.filter(size > giant), model, chunk, schema))


def _giants(docs: DataFrame, model: str, chunk: int, schema: T.StructType) -> DataFrame:
    """As encode, by the scan over chunks that many tasks share."""
    reach = pieces_of(model).reach
    at = Workspace(docs.sparkSession, "encoding")
    # Other columns go along in one struct, so no name of theirs can clash.
    named = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "ids"]
    keyed = docs.select(F.sha2("text", 256).alias("key"), F.struct(*named).alias("row"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bh.tidy(batches):
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                u = " " + t.as_py()  # (a blank before the text is the dummy prefix)
                for i, k in enumerate(range(0, len(u), chunk)):
                    yield pa.RecordBatch.from_pydict({"key": [key], "i": pa.array([i], pa.int32()), "u": [u[k : k + chunk + reach - 1]], "n": pa.array([min(chunk, len(u) - k)], pa.int32())})

    # Giants are read once and equal texts encoded once.
    chunks = keyed.select("key", F.col("row.text").alias("text")).dropDuplicates(["key"]).mapInArrow(split, "key string, i int, u string, n int")
    chunks = at.keep(chunks.repartition("key", "i"), "chunks")

    def each(columns: str, f) -> object:
        """Rows of (key, i) and f of the other columns."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = pieces_of(model)
            for b in bh.tidy(batches):
                rows = [f(p, marked(r.u), r.n, r) for r in b.itertuples()]
                yield b[["key", "i"]].assign(**{columns.split()[0]: pd.Series(rows, dtype=object, index=b.index)})

        return lambda df: df.mapInPandas(run, f"key string, i int, {columns}")

    def group(f, column: str, kind: str):
        """Of all rows of a key in order, f of the named column: chunk by chunk.  (reach * reach numbers for ``chunk`` characters.)"""

        def run(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("i")
            return b[["key", "i"]].assign(x=f(list(b[column])))

        return lambda df: df.groupBy("key").applyInPandas(run, f"key string, i int, x {kind}")

    square = lambda b: np.frombuffer(b, np.int64).reshape(reach, reach)
    line = lambda b: np.frombuffer(b, np.int64)
    m = each("m binary", lambda p, u, n, r: p.matrix(u, n).tobytes())(chunks)
    v = at.keep(group(lambda x: [y.tobytes() for y in arrived([square(b) for b in x])], "m", "binary")(m).withColumnRenamed("x", "v"), "arrived")
    f = each("f binary", lambda p, u, n, r: p.enters(u, n, line(r.v)).tobytes())(chunks.join(v, ["key", "i"]))
    s = group(lambda x: followed([line(b) for b in x]), "f", "int")(f).withColumnRenamed("x", "end")
    done = each("ids array<int>", lambda p, u, n, r: np.frombuffer(p.trace(u, n, r.end, line(r.v)), np.int32))(chunks.join(v, ["key", "i"]).join(s, ["key", "i"]))
    done = done.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("parts")).select("key", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
    d = keyed.join(at.keep(done, "ids"), "key", "left")
    at.drop("chunks", "arrived")
    return d.select(*[F.col("row").getField(c).alias(c) for c in schema.names if c != "ids"], "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with text, from its ids."""
    at = encoded.columns.index("ids")
    schema = _with(encoded, "text", T.StringType())
    keep = [i for i, c in enumerate(encoded.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in bh.tidy(batches):
            for i in range(0, b.num_rows, 512):
                s = b.slice(i, 512)
                text = pa.array([None if x is None else p.decode(x) for x in s.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(s.column(k) for k in keep), text], names=schema.names)

    return encoded.mapInArrow(run, schema)
