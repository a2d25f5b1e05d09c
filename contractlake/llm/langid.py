"""Language identification by compression with per-language zstandard dictionaries.

A language's dictionary is raw text: excerpts of labelled documents of that language. A text is cut
into blocks, each block is compressed with the dictionary of every language, and the language with
the fewest bytes in total is chosen. Both are put in lower case before. Blocks keep a long text from
becoming its own dictionary, so all of a text counts alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, slices, text_column


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", excerpts: int = 96, excerpt_chars: int = 2000, languages: int = 256) -> dict[str, bytes]:
    """Each language's dictionary, from the rows for which `train` holds.

    The sample is bounded: at most `excerpts` excerpts of `excerpt_chars` characters a language, from the
    rows with the least key hash in each of as many hash buckets. Where in its text an excerpt begins is
    drawn by another hash, over the whole text. A language that has one usable row
    is learned. Rows without a language or without a letter teach nothing. Of more than `languages`
    different values, those with most rows are learned (ties: by name), which bounds the sample where
    the column holds anything else than languages; that takes one more pass, over two columns.
    """
    known = docs.filter(train & docs[lang].isNotNull())
    names = [r["lang"] for r in known.groupBy(docs[lang].alias("lang")).count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    rows = known.filter(docs[lang].isin(names) & text_column(docs[text]).rlike(r"\p{L}")).select(docs[lang].alias("lang"), docs[text].alias("text"), F.xxhash64(docs[key], F.lit(11)).alias("h"), F.xxhash64(docs[key], F.lit(12)).alias("place"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(excerpts)).alias("bucket")).agg(F.min("h").alias("h"))
    # at most `excerpts` hashes a language
    start = F.pmod("place", F.greatest(F.length("text") - excerpt_chars + 1, F.lit(1))).cast("int") + 1
    chosen = rows.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).select("lang", "h", F.substring("text", start, F.lit(excerpt_chars)).alias("text"))
    got = chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    found: dict[str, list[tuple[int, str]]] = {}
    for r in got:
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return {k: "\n".join(t.lower() for _, t in sorted(v)).encode("utf-8", "replace") for k, v in sorted(found.items())}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None, level: int = 6, block_bytes: int = 2048, min_margin: float = 0.02) -> DataFrame:
    """Kept columns (default doc_id) with lang_pred string, score double, margin double, accepted boolean.

    lang_pred is `und` for a text that is null or has no letter, or if no language was learned; its
    score and margin are 0. margin is the share of bytes that the chosen language saves against the
    next; accepted is false where it is below `min_margin`. Ties go to the first language by name.
    score is 1 where the bytes leave no doubt and 1 / languages where all are equal. A text of any
    length is compressed whole, repeated rows are answered each, an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    langs = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by fit's sample
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names, strict=True)], text_column(docs[text]).alias("body"))
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + ["lang_pred string, score double, margin double, accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        coders = []
        for name in langs:
            d = z.ZstdCompressionDict(shared.value[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        for batch in slices(batches):
            out = []
            for t in batch.column("body").to_pylist():
                if not coders or not any(map(str.isalpha, t)):
                    out.append(("und", 0.0, 0.0, False))
                    continue
                raw = t.lower().encode("utf-8", "replace")
                blocks = [raw[k : k + block_bytes] for k in range(0, len(raw), block_bytes)]
                sizes = np.array([sum(len(c(b)) for b in blocks) for c in coders], dtype=np.float64)
                best = int(sizes.argmin())
                rest = np.delete(sizes, best)
                margin = float((rest.min() - sizes[best]) / rest.min()) if rest.size else 1.0
                out.append((langs[best], float(1 / np.exp((sizes[best] - sizes) / 4).sum()), margin, margin >= min_margin))
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + columns, names=[*names, "lang_pred", "score", "margin", "accepted"])

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score", "margin", "accepted")
