"""Token counts by offset-mapped attribution.

A record is a list of sections (lines of a document, turns of a conversation,
fields of a row) whose concatenation is its whole text.  The text is encoded
once, so tokens are those of the whole, not of the parts.  Token lengths give
every token's span; spans are joined to section intervals by binary search; a
token that crosses a boundary goes to one section by an explicit rule:

* ``majority``: the section that holds most of its bytes, the first on a tie;
* ``first`` / ``last``: the section that holds its first / last byte.

Counts over sections therefore add up to the count of the whole text.

Work is one pass of Arrow batches without a shuffle; a section row is emitted
for each section.  Defined results: a null section is empty and gets 0 tokens; a
null record or one without sections gives no rows (a null text of ``documents``
has no lines; an empty text has one, with 0 tokens); repeated rows are counted
each; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.bpe import ranks
from skein.llm.columns import documents, let

VOCABULARY = "byte_bpe_50k.tiktoken"
RULE = "majority"


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    of = ranks(path)
    lengths = np.zeros(max(of.values()) + 1, np.int64)
    for token, i in of.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=of, special_tokens={}), lengths


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section.

    ``ends``: byte offsets at which tokens end; ``bounds``: those at which
    sections end.  Empty sections hold no byte and get no token.
    """
    n = len(bounds)
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not len(ends):
        return counts, crossing
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    own = first.copy() if rule != "last" else last.copy()
    across = np.nonzero(first != last)[0]
    if rule == "majority":
        for t in across:
            at = np.arange(first[t], last[t] + 1)
            low = np.maximum(np.where(at > 0, bounds[at - 1], 0), starts[t])
            own[t] = at[np.argmax(np.minimum(bounds[at], ends[t]) - low)]
    counts += np.bincount(own, minlength=n)
    crossing += np.bincount(own[across], minlength=n)
    return counts, crossing


def _count(path: str, pattern: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(path, pattern)
        for b in batches:
            sections = b.column("sections")
            out = []
            for i in range(b.num_rows):
                parts = [(p or "") for p in (sections[i].as_py() or [])]
                ids = encoder.encode_ordinary("".join(parts))
                bounds = np.cumsum([len(p.encode()) for p in parts]).astype(np.int64)
                counts, crossing = attribute(np.cumsum(lengths[ids]), bounds, rule)
                out.append([{"n_tokens": int(c), "n_crossing": int(x), "n_chars": len(p)} for c, x, p in zip(counts, crossing, parts)])
            kind = pa.list_(pa.struct([("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("n_chars", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "counts"])

    return run


def section_tokens(
    df: DataFrame, key: str, sections: Column, path: str, rule: str = RULE, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """(key, section, n_chars, n_tokens, n_crossing): one row per section, numbered from 0."""
    if rule not in ("majority", "first", "last"):
        raise ValueError(f"no such rule: {rule}")
    kind = df.schema[key].dataType.simpleString()
    counted = df.select(F.col(key).alias("id"), sections.alias("sections")).mapInArrow(
        _count(path, pattern, rule), f"id {kind}, counts array<struct<n_tokens:long,n_crossing:long,n_chars:long>>"
    )
    return counted.select("id", F.posexplode("counts").alias("section", "c")).select(
        F.col("id").alias(key), "section", F.col("c.n_chars"), F.col("c.n_tokens"), F.col("c.n_crossing")
    )


def lines(text: Column) -> Column:
    """A text's lines, each with its line feed; null for null."""
    return let(
        F.split(text, "\n"),
        lambda cut: F.transform(cut, lambda x, i: F.when(i < F.size(cut) - 1, F.concat(x, F.lit("\n"))).otherwise(x)),
    )


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return section_tokens(docs, "doc_id", lines(F.col("text")), public_tokenizers.path(VOCABULARY))


QUERIES = {"op5_token_attribution": op5_token_attribution}
ORACLES: dict[str, str] = {}
