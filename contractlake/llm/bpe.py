"""BPE encoding and decoding, long texts by tree concatenation.

Short texts are encoded as they are. A long text is cut into leaves of equal length, without regard
to words, and the leaves are encoded as rows of their own, spread over the cluster. Neighbours are then
joined, pair by pair, up a tree: the text around a join is encoded again in a window that grows until
it agrees with the left side at one token and with the right side at one token. What lies between those
two tokens is taken from the window. Of a very long text, runs of leaves meet first, then the runs.

Why agreement at one token is enough: a sequence of BPE tokens is the encoding of its text when each
pair of neighbours is. Pairs inside a side or inside the window are; the pair at the cut is a pair of
the side, as the token beyond the cut is the same in both. The cut itself must lie behind white
space, or between letters, where both readings see the same word. A window that finds no such token
grows to both sides whole, which is the plain encoding.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from string import ascii_letters

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, slices, text_column

#: Words remembered in a worker process; the memory starts anew beyond it.
MEMORY = 300_000
#: Marks that end a word; between an ASCII letter and a run of them lies a cut that no token crosses.
MARKS = ".,*&$%#!?;:|)"
#: White space to str.split, but an ordinary character to the tokenizer.
ODD = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[^ \t-\r]+")

#: Rows (first character, character after the last, id), one per token.
Spans = np.ndarray


class Bpe:
    """A tokenizer file in one worker process."""

    opened: dict[str, Bpe] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("a tokenizer with a decoder of its own does not decode word by word")
        self.tokens = pa.array([self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())], pa.string())
        self.memory: dict[str, bytes] = {}
        #: First window of a join: no added token is longer, so the window around a cut shows whole what the cut divides.
        self.window = max(32, *(2 * len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), 0)

    @classmethod
    def of(cls, path: str) -> Bpe:
        """One for all tasks of a worker process, so that words are learned once."""
        if path not in cls.opened:
            cls.opened[path] = cls(path)
        return cls.opened[path]

    def spans(self, text: str, at: int = 0) -> Spans:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, dtype=np.int64)
        return np.column_stack([np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at, ids])

    def learn(self, words: set[str]) -> None:
        """Encode new words, all in one text: no token crosses the space between them."""
        memory = self.memory
        parts = {w: two for w in words if (two := _parts(w))}
        new = [w for w in words if w not in parts]
        new += {p for two in parts.values() for p in two if p not in memory and p not in words}
        if new:
            e = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(e.ids))
            cuts = (4 * np.searchsorted(starts, np.cumsum([0] + [len(w) + 1 for w in new]))).tolist()
            raw = np.array(e.ids, dtype=np.int32).tobytes()
            memory.update(zip(new, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        for w, (core, marks) in parts.items():
            memory[w] = memory[core] + memory[marks]

    def answers(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text, by its words."""
        split = [_BLANKS.findall(t) if ODD.search(t) else t.split() for t in texts]
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        new = set().union(*split).difference(memory)
        if new:
            self.learn(new)
        return id_lists([b"".join(map(memory.__getitem__, words)) for words in split])

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """As the tokenizer decodes without a decoder: the tokens joined by spaces, special ones too."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values)), " ")


def _parts(word: str) -> tuple[str, str] | None:
    """A word cut before its closing marks, where it has such behind an ASCII letter.

    Other letters may end in a mark once they are in lower case, and would join the marks.
    """
    core = word.rstrip(MARKS)
    return (core, word[len(core) :]) if len(core) < len(word) and core and core[-1] in ascii_letters else None


def id_lists(raw: list[bytes]) -> pa.ListArray:
    """An array of int32 lists from their bytes."""
    offsets = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32)))


def packed(spans: Spans) -> np.ndarray:
    """Gaps before the tokens, their lengths, their ids: small numbers, which shuffle files compress well."""
    ends = np.concatenate([[0], spans[:-1, 1]]) if len(spans) else spans[:, 1]
    return np.concatenate([spans[:, 0] - ends, spans[:, 1] - spans[:, 0], spans[:, 2]]).astype(np.int32)


def unpacked(numbers: np.ndarray) -> Spans:
    gaps, lengths, ids = np.asarray(numbers, dtype=np.int64).reshape(3, -1)
    ends = np.cumsum(gaps + lengths)
    return np.column_stack([ends - lengths, ends, ids])


def digests(tokens: DataFrame) -> DataFrame:
    """ids and decoded of encode_texts replaced by n_tokens, ids_sha256 and decoded_sha256."""
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    kept = [c for c in tokens.columns if c not in ("ids", "decoded")]
    return tokens.select(*kept, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _letter(c: str) -> bool:
    """A letter, also in lower case, and long enough known that every library takes it as one."""
    return c.isalpha() and c.lower().isalpha() and unicodedata.ucd_3_2_0.category(c)[0] == "L"


def _blank(c: str) -> bool:
    return c.isspace() and not ODD.match(c)


def _cuts(tokens: Spans, text: str, offset: int) -> dict[tuple[int, int, int], int]:
    """Tokens at which one reading may pass to another, with their places."""
    found, end = {}, -1
    for k, (a, b, i) in enumerate(map(tuple, tokens.tolist())):
        p = a - offset
        if a >= end and a < b and 0 < p < len(text) and (_blank(text[p - 1]) or _letter(text[p - 1]) and _letter(text[p])):
            found[a, b, i] = k
        end = max(end, b)
    return found


def join_spans(encode: Callable[[str, int], Spans], text: str, middle: int, left: Spans, right: Spans, window: int) -> Spans:
    """Tokens of text from those of text[:middle] and text[middle:]; spans count from the text's start.

    window, the first one's length to each side, must not be less than an added token's.
    """
    while True:
        a, b = max(0, middle - window), min(len(text), middle + window)
        new = encode(text[a:b], a)
        usable = _cuts(new, text[a:b], a)
        first = (0, 0) if a == 0 else None
        if first is None:
            skip = max(0, len(left) - 4 * window)
            near = {t: k for t, k in _cuts(left[skip:], text, 0).items() if t[0] > a}
            both = [t for t in usable if t in near and t[1] <= middle]
            if both:
                t = min(both)
                first = (near[t] + skip, usable[t])
        last = (len(new), len(right)) if b == len(text) else None
        if last is None:
            near = _cuts(right[: 4 * window], text, 0)
            both = [t for t in usable if t in near and t[0] > middle]
            if both:
                t = max(both)
                last = (usable[t], near[t])
        if first and last and first[1] <= last[0]:
            return np.concatenate([left[: first[0]], new[first[1] : last[0]], right[last[1] :]])
        window *= 2


def tree_concatenate(encode: Callable[[str, int], Spans], leaves: list[str], tokens: list[Spans], window: int = 32) -> Spans:
    """Tokens of the leaves' whole text; each leaf's spans count from the leaf's start."""
    parts = list(zip(leaves, tokens, strict=True))
    while len(parts) > 1:
        joined = []
        for k in range(0, len(parts) - 1, 2):
            (x, p), (y, q) = parts[k : k + 2]
            joined.append((x + y, join_spans(encode, x + y, len(x), p, q + np.array([len(x), len(x), 0]), window)))
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    return parts[0][1] if parts else np.zeros((0, 3), dtype=np.int64)


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, long_chars: int = 36_000, leaf_chars: int = 12_000, run: int = 64, out: str = "digest") -> DataFrame:
    """Encode every whole text and decode it again.

    docs: any columns; `keep` (default ["doc_id"]) are carried along. Null texts count as empty and
    have no token; a text of any length is taken whole, and repeated rows are answered each; an empty
    table gives no rows.
    Returns the kept columns and, with out="digest", n_tokens long, ids_sha256 string (of the decimal
    ids joined by spaces) and decoded_sha256 string; with out="ids", ids array<int> and decoded string.
    Texts of more than `long_chars` characters go through the tree, in leaves of `leaf_chars`; where a
    text has more than `run` leaves, runs of so many are joined in tasks of their own first.

    tokenizer: path of a tokenizer file, the same on every executor, whose normalisation and splitting
    keep words apart at white space.
    """
    short_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], text_column(docs[text]).alias("body"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{n} {kinds[n]}" for n in names] + ["ids array<int>, decoded string"])
    fields = ["ids", "decoded"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer)
        for batch in slices(batches):
            ids = bpe.answers(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids, bpe.decoded(ids)], names=names + fields)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer)
        for batch in slices(batches, 64):
            flat = [packed(bpe.spans(t)) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat, pa.list_(pa.int32()))], names=[*batch.schema.names, "spans"])

    def joined(group: pd.DataFrame) -> tuple[str, Spans]:
        group = group.sort_values("leaf")
        bpe, leaves = Bpe.of(tokenizer), group["body"].tolist()
        return "".join(leaves), tree_concatenate(bpe.spans, leaves, [unpacked(s) for s in group["spans"]], bpe.window)

    def some(group: pd.DataFrame) -> pd.DataFrame:
        body, spans = joined(group)
        first = group.iloc[:1].drop(columns=["run"])
        return first.assign(leaf=group["leaf"].min(), body=body, spans=[packed(spans)])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        ids = id_lists([joined(group)[1][:, 2].astype(np.int32).tobytes()])
        return pd.DataFrame({n: group[n].iloc[:1].to_numpy() for n in names} | {"ids": [ids.values.to_numpy()], "decoded": Bpe.of(tokenizer).decoded(ids).to_pylist()})

    count = F.ceil(F.length("body") / leaf_chars).cast("int")
    plain = rows.filter(F.length("body") <= long_chars).mapInArrow(short, schema)
    tree = ", ".join(["row long", *(f"{n} {kinds[n]}" for n in names), "body string, leaf int, spans array<int>"])

    def leaves(long: DataFrame) -> DataFrame:
        at: Column = F.explode(F.sequence(F.lit(0), count - 1))
        cut = long.withColumn("row", F.monotonically_increasing_id()).select("row", *names, "body", at.alias("leaf"))
        return cut.withColumn("body", F.substring("body", F.col("leaf") * leaf_chars + 1, F.lit(leaf_chars))).repartition("row", "leaf").mapInArrow(leaf, tree)

    long = rows.filter(F.length("body") > long_chars)
    few = leaves(long.filter(count <= run))
    runs = leaves(long.filter(count > run)).withColumn("run", F.expr(f"leaf div {run}")).groupBy("row", "run").applyInPandas(some, tree)
    both = plain
    for parts in (few, runs):
        both = both.unionByName(parts.groupBy("row").applyInPandas(whole, schema))
    both, fields = (digests(both), ["n_tokens", "ids_sha256", "decoded_sha256"]) if out == "digest" else (both, fields)
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *fields)
