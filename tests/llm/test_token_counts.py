import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from data import SCHEMA, awkward_rows, frame
from skein.llm import token_counts as t
from skein.llm.bpe import ranks

PATH = public_tokenizers.path(t.VOCABULARY)
EXACT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(PATH), special_tokens={})


def brute(sections, rule):
    owner = [k for k, s in enumerate(sections) for _ in s.encode()]
    counts, crossing, at = [0] * len(sections), [0] * len(sections), 0
    for i in EXACT.encode_ordinary("".join(sections)):
        own = owner[at : at + len(EXACT.decode_single_token_bytes(i))]
        at += len(own)
        pick = {"first": own[0], "last": own[-1], "majority": max(sorted(set(own)), key=own.count)}[rule]
        counts[pick] += 1
        crossing[pick] += len(set(own)) > 1
    return list(zip(range(len(sections)), map(len, sections), counts, crossing))


def cut(text):
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + parts[-1:]


def test_lines_match_brute_force(spark):
    rows = awkward_rows() + [(700, "a\n\n\n\n b\n \n\n  é🙂\n\n\n", "en", "s", 1)]
    for rule in ("majority", "first", "last"):
        df = frame(spark, rows).selectExpr("*", "1 as id", "2 as counts")
        got = t.section_tokens(df, "doc_id", t.lines(F.col("text")), PATH, rule).collect()
        want = [(r[0], *x) for r in rows if r[1] is not None for x in brute(cut(r[1]), rule)]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sections_inside_words_add_up_to_the_whole():
    text = "unbelievable internationalization of strings"
    for step in (1, 2, 3, 5):
        parts = [text[i : i + step] for i in range(0, len(text), step)]
        ends = np.cumsum([len(EXACT.decode_single_token_bytes(i)) for i in EXACT.encode_ordinary(text)])
        for rule in ("majority", "first", "last"):
            counts, crossing = t.attribute(ends, np.cumsum([len(p) for p in parts]), rule)
            assert [tuple(x) for x in zip(range(len(parts)), map(len, parts), counts, crossing)] == brute(parts, rule)
            assert counts.sum() == len(EXACT.encode_ordinary(text))


def test_empty_and_null_sections(spark):
    assert t.section_tokens(spark.createDataFrame([], SCHEMA), "doc_id", t.lines(F.col("text")), PATH).count() == 0
    df = spark.createDataFrame([("a", ["x y", None, "", "z"]), ("b", None), ("c", [])], "k string, parts array<string>")
    got = t.section_tokens(df, "k", F.col("parts"), PATH).orderBy("section").collect()
    assert [(r.k, r.section, r.n_chars) for r in got] == [("a", 0, 3), ("a", 1, 0), ("a", 2, 0), ("a", 3, 1)]
