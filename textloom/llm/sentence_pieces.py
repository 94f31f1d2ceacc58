"""SentencePiece encoding and decoding, with giant documents cut into chunks that are encoded apart.

The vocabulary's file says which kind of model it is. Both kinds are paths through the lattice of pieces, and both
are solved by max-plus algebra: a unigram path weighs the sum of its pieces' scores; a BPE path weighs 0 if each two
neighbours are what BPE makes of their joint text, else minus infinity (such a path exists and is unique). What a
chunk has to know of its neighbours is the piece that lies across, or ends at, its first position (state in) and
the one at its last (state out). So:

1. Each chunk gives a transfer matrix from states in to states out. Between the first and the last place of the
   chunk where no piece can lie across, the library encodes; only the fringes need the lattice. A chunk without such
   a place is solved by the lattice alone.
2. Matrices multiply associatively, so they are scanned in parallel: products of FAN neighbours, products of FAN of these, and
   so on up to one small group a document; that one is solved between clean ends, and states go down
   again level by level, each group between the states of its own two ends. A task never holds more than FAN matrices of a document.
3. Each chunk traces its own pieces back between its states, independently of the others.

Documents of at most ``chunk`` characters are one chunk between two certain states, which is the library's work
alone; words between single spaces recur and are kept. Decoding joins the bytes of the pieces.

Defined cases: of unigram paths with equal scores any may be taken where a chunk is cut; a null or empty text has no ids, and no ids decode to an empty text; characters outside the
vocabulary are bytes if the model has byte pieces, else the unknown piece; U+2581, which pieces write for a space, is
encoded as one and decodes to a space, so a text that holds it has no round trip; equal rows are encoded each; columns
beyond the text are kept, ids is replaced if it is there; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from textloom.llm.bpe_words import TOKENIZERS
from textloom.llm.common import bounded_batches, table, text_or_empty, written

SPACE = "▁"
CHUNK = 32_768
#: Matrices that are multiplied in one group of the scan.
FAN = 64
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6

State = tuple[int, int, int]  # start and end of a piece, counted from the cut, and its id; (0, 0, -1): nothing lies across
CLEAN: State = (0, 0, -1)


class Pieces:
    """A model file: the library's processor and what the lattice needs."""

    def __init__(self, path: str, keep: int = 200_000):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            raw = f.read()
        proto.ParseFromString(raw)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bpe = proto.trainer_spec.model_type == 2
        own = [(p.piece, k, p.score) for k, p in enumerate(proto.pieces) if p.type == NORMAL]
        if any(p.type == USER for p in proto.pieces) or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("models with user-defined pieces or text normalisation are not supported")
        self.ids = {p: k for p, k, _ in own}
        self.scores = {p: s for p, _, s in own}
        self.longest = max(map(len, self.ids))
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_score = min(self.scores.values()) - 10
        byte = {int(p.piece[1:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes = [byte[k] for k in range(256)] if len(byte) == 256 else None
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.by_word = not any(SPACE in x[1:] and x[0] != SPACE for x in self.inner)
        self.texts = [{NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)])}.get(p.type, lambda p: b"")(p.piece) for p in proto.pieces]
        self._keep, self._words = keep, {}
        self._valid: dict[tuple[str, str], bool] = {}

    def escaped(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def char_ids(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32 bytes."""
        words = text.split(" ")
        if not self.by_word or "" in words or SPACE in text:
            return np.array(self.sp.encode(text), "<i4").tobytes()
        known = self._words
        new = list({w for w in words if w not in known})
        if new:
            if len(known) + len(new) > self._keep:
                known.clear()
                new = list(set(words))
            for w, ids in zip(new, self.sp.encode(new, num_threads=1)):
                known[w] = np.array(ids, "<i4").tobytes()
        return b"".join(map(known.__getitem__, words))

    def encode_escaped(self, s: str) -> list[int]:
        """Ids of an escaped string that begins and ends where no piece lies across."""
        if s.startswith(SPACE):
            return self.sp.encode(s[1:].replace(SPACE, " ")) if len(s) > 1 else self.trace(s, 0, CLEAN, len(s), CLEAN)
        return self.trace(s, 0, CLEAN, len(s), CLEAN)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")

    def hard(self, s: str, at: int) -> bool:
        """Whether no piece can lie across position at."""
        return at <= 0 or at >= len(s) or s[at - 1 : at + 1] not in self.inner

    def merged(self, s: str) -> list[str]:
        parts = list(s)
        while len(parts) > 1:
            best, k = max((self.scores.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1))
            if best == -np.inf:
                break
            parts[-k : 2 - k] = [parts[-k] + parts[1 - k]]
        return parts

    def made(self, piece: str) -> bool:
        """Whether BPE makes the piece of its own characters."""
        out = self._valid.get((piece, ""))
        if out is None:
            out = self._valid[piece, ""] = self.merged(piece) == [piece]
        return out

    def certain(self, s: str, a: int, b: int) -> tuple[int | None, int | None]:
        """The first and the last place in [a, b] where no piece can lie across; the first one before a space, if there is any, as the library starts there."""
        at = [i for i in (*range(a, min(b, a + 4 * self.longest) + 1), *range(max(a, b - 4 * self.longest), b + 1)) if self.hard(s, i)] or [i for i in range(a, b + 1) if self.hard(s, i)]
        if not at:
            return None, None
        return next((i for i in sorted(at) if s[i : i + 1] == SPACE), min(at)), max(at)

    def follows(self, a: str, b: str) -> bool:
        """Whether piece b may stand behind piece a."""
        if not self.bpe or a[-1] + b[0] not in self.inner:
            return True
        out = self._valid.get((a, b))
        if out is None:
            if len(self._valid) > 100_000:
                self._valid.clear()
            out = self._valid[a, b] = self.merged(a + b) == [a, b]
        return out

    def paths(self, s: str, at: int, state: State, to: int) -> tuple[dict, dict]:
        """Best paths from a state at position at: (score, node before) by node, and by those nodes where a path ends.

        A node is (start, end) of a piece. A path ends with the piece that starts before position ``to`` and ends
        there or behind.
        """
        root = (at + state[0], at + state[1])
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {root: (0.0, None)}
        by_end: dict[int, list[tuple[int, int]]] = {root[1]: [root]}
        for p in range(root[1], to):
            for q in range(p + 1, min(len(s), p + self.longest) + 1) if p in by_end else ():
                piece = s[p:q]
                if q > p + 1 and s[q - 2 : q] not in self.inner:
                    break
                score = self.scores.get(piece)
                if score is None:
                    if q > p + 1:
                        continue
                    score = self.unknown_score
                if self.bpe:
                    score = 0.0
                    if q > p + 1 and not self.made(piece):
                        continue
                found = None
                for n in by_end[p]:
                    if (n == root and state == CLEAN) or self.follows(s[n[0] : n[1]], piece):
                        total = best[n][0] + score
                        if found is None or total > found[0]:
                            found = (total, n)
                if found:
                    best[p, q] = found
                    by_end.setdefault(q, []).append((p, q))
        ends = {n: v for n, v in best.items() if n[1] >= to and n[0] < to} if root[1] < to else {root: best[root]}
        return best, ends

    def states(self, s: str, at: int) -> list[State]:
        """Pieces that may lie across position at, or end there; one clean state where none can lie across."""
        if self.hard(s, at):
            return [CLEAN]
        out = []
        for p in range(max(0, at - self.longest), at):
            for q in range(at, min(len(s), p + self.longest) + 1):
                if q == p + 1 or s[p:q] in self.ids:
                    out.append((p - at, q - at, self.ids.get(s[p:q], -2)))
        return out

    def transfer(self, s: str, a: int, b: int) -> dict[State, dict[State, float]]:
        """The matrix of the chunk [a, b) of the string s, which has the neighbours' characters around it."""
        first, last = self.certain(s, a, b)

        def leaves(at: int, state: State, to: int) -> dict[State, float]:
            if at + state[1] >= to and state != CLEAN:
                return {CLEAN: 0.0} if self.hard(s, to) else {(at + state[0] - to, at + state[1] - to, state[2]): 0.0}
            ends = self.paths(s, at, state, to)[1]
            if self.hard(s, to):
                return {CLEAN: max(v[0] for n, v in ends.items() if n[1] == to)} if any(n[1] == to for n in ends) else {}
            return {(n[0] - to, n[1] - to, self.ids.get(s[n[0] : n[1]], -2)): v[0] for n, v in ends.items()}

        if first is None:
            return {x: leaves(a, x, b) for x in self.states(s, a)}
        middle = sum(self.scores.get(self.sp.id_to_piece(k), self.unknown_score) for k in self.encode_escaped(s[first:last])) if not self.bpe and first < last else 0.0
        right = {CLEAN: 0.0} if last == b else leaves(last, CLEAN, b)
        left = {CLEAN: {CLEAN: 0.0}} if first == a else {x: leaves(a, x, first) for x in self.states(s, a)}
        return {x: {y: u + middle + v for y, v in right.items()} for x, to in left.items() for u in to.values()}

    def trace(self, s: str, a: int, x: State, b: int, y: State) -> list[int]:
        """Ids of the pieces that start in [a, b), between states x at a and y at b."""
        if a + x[1] >= b and x != CLEAN:
            return []
        best, ends = self.paths(s, a, x, b)
        node = max((n for n in ends if n[1] == b), key=lambda n: ends[n][0]) if y == CLEAN else (b + y[0], b + y[1])
        out: list[list[int]] = []
        while best[node][1] is not None:
            piece = s[node[0] : node[1]]
            out.append([self.ids[piece]] if piece in self.ids else self.char_ids(piece))
            node = best[node][1]
        return [k for ids in reversed(out) for k in ids]

    def chunk_ids(self, s: str, a: int, x: State, b: int, y: State) -> list[int]:
        """trace(), with the library between the first and the last place where no piece lies across."""
        first, last = self.certain(s, a, b)
        if first is None:
            return self.trace(s, a, x, b, y)
        left = [] if first == a else self.trace(s, a, x, first, CLEAN)
        right = [] if last == b else self.trace(s, last, CLEAN, b, y)
        return left + (self.encode_escaped(s[first:last]) if first < last else []) + right


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices; associative."""
    out = {}
    for x, row in a.items():
        own: dict[State, float] = {}
        for y, u in row.items():
            for z, v in b.get(y, {}).items():
                own[z] = max(u + v, own.get(z, -np.inf))
        out[x] = own
    return out


def chain(matrices: list[dict], start: State = CLEAN, end: State = CLEAN) -> list[tuple[State, State]]:
    """(state in, state out) of each matrix on the best path from start to end."""
    ahead = [{start: 0.0}]
    for m in matrices:
        ahead.append(product({start: ahead[-1]}, m)[start])
    y, out = end, []
    for k in range(len(matrices) - 1, -1, -1):
        x = max((x for x in matrices[k] if y in matrices[k][x] and x in ahead[k]), key=lambda x: ahead[k][x] + matrices[k][x][y])
        out.append((x, y))
        y = x
    return out[::-1]


@functools.lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


def _packed(matrix: dict) -> str:
    return json.dumps([[x, [[y, v] for y, v in row.items()]] for x, row in matrix.items()])


def _unpacked(raw: str) -> dict:
    return {tuple(x): {tuple(y): v for y, v in row} for x, row in json.loads(raw)}


def scan(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(row, no, states) from (row, no, matrix): the states in and out of each chunk, as JSON."""
    group = F.floor(F.col("no") / fan).cast("int").alias("group")

    def multiplied(b: pd.DataFrame) -> pd.DataFrame:
        found = functools.reduce(product, map(_unpacked, b.sort_values("no")["matrix"]))
        return pd.DataFrame({"row": b["row"].iloc[:1], "no": b["group"].iloc[:1], "matrix": [_packed(found)]})

    def solved(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("no")
        ends = [tuple(x) for x in json.loads(b["ends"].iloc[0])] if "ends" in b else (CLEAN, CLEAN)
        return b[["row", "no"]].assign(states=[json.dumps(x) for x in chain([_unpacked(x) for x in b["matrix"]], *ends)])

    levels, last = [matrices], matrices.agg(F.max("no")).first()[0] or 0  # one number
    while last >= fan:
        levels.append(written(levels[-1].select("*", group).groupBy("row", "group").applyInPandas(multiplied, "row long, no int, matrix string"), "products"))
        last //= fan
    states = levels.pop().groupBy("row").applyInPandas(solved, "row long, no int, states string")
    for level in reversed(levels):
        ends = states.select("row", F.col("no").alias("group"), F.col("states").alias("ends"))
        states = level.select("*", group).join(ends, ["row", "group"]).groupBy("row", "group").applyInPandas(solved, "row long, no int, states string")
    return states


def encode(docs: DataFrame, *, path: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK) -> DataFrame:
    """docs with ids array<int> of the text, which itself is dropped."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(ids)
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    giant = F.length(text_or_empty(text)) > chunk

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield b.drop(columns=text).assign(**{ids: [np.frombuffer(m.encode(t), "<i4") if t else np.zeros(0, "<i4") for t in b[text].fillna("")]})

    small = docs.filter(~giant).mapInPandas(whole, schema)
    large = written(docs.filter(giant).withColumn("__row", F.monotonically_increasing_id()), "giants")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            rows = []
            for r, t in zip(b["__row"], b[text]):
                s, pad = m.escaped(t), 2 * m.longest
                rows += [(r, no, s[max(0, a - pad) : a + chunk + pad], min(a, pad), min(a, pad) + min(chunk, len(s) - a)) for no, a in enumerate(range(0, len(s), chunk))]
            yield pd.DataFrame(rows, columns=["row", "no", "s", "a", "b"])

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield b[["row", "no"]].assign(matrix=[_packed(m.transfer(s, x, y)) for s, x, y in zip(b["s"], b["a"], b["b"])])

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            own = [[tuple(x) for x in json.loads(s)] for s in b["states"]]
            yield b[["row", "no"]].assign(ids=[m.chunk_ids(s, a, x, e, y) for s, a, e, (x, y) in zip(b["s"], b["a"], b["b"], own)])

    chunks = written(large.select("__row", text).mapInPandas(cut, "row long, no int, s string, a int, b int").repartition("row", "no"), "chunks")
    between = scan(written(chunks.mapInPandas(matrices, "row long, no int, matrix string"), "matrices"))
    parts = chunks.join(between, ["row", "no"]).mapInPandas(traced, "row long, no int, ids array<int>")
    joined = parts.groupBy(F.col("row").alias("__row")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias(ids))
    return small.unionByName(large.drop(text).join(joined, "__row").drop("__row"))


def decode(df: DataFrame, *, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text that its ids say."""
    df = df.drop(text)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            yield b.assign(**{text: ["" if x is None else m.decode(x) for x in b[ids]]})

    return df.mapInPandas(joined, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs, without text, with n_tokens, ids_sha256 of the ids joined by commas, and whether decoding them gives the text again."""
    docs = docs.withColumn("__sha", F.sha2(text_or_empty(), 256))
    back = decode(encode(docs, path=path), path=path)
    return back.select(*[c for c in docs.columns if c not in ("text", "__sha")], F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), (F.sha2("text", 256) == F.col("__sha")).alias("round_trip"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")
