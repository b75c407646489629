import hashlib
import re
from collections import Counter

import tiktoken
import public_tokenizers

import corpus_pipeline as p
from data import awkward_rows, frame
from skein.llm import bpe, secrets
from test_quality import brute as base_counts
from test_simhash import brute_components, brute_fp

PATH = public_tokenizers.path(bpe.VOCABULARY)
EXACT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_stages_match_brute_force(spark, tmp_path):
    rows = awkward_rows()
    rows += [(800, rows[4][1] + ' token = "0123456789abcdef01234567" end', "en", "src1", 1), (801, rows[5][1], "en", "src0", 1)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for n, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == columns and out.dtypes == docs.dtypes
        path = str(tmp_path / f"stage{n}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())

    quality, deduped, redacted, mixed, encoded = kept
    # No line of these rows but the notice is on more than five documents of a host.
    notice = Counter((r[3], "the shared notice of this host, all rights") for r in rows if r[1] and r[1].startswith("the shared notice"))
    hot = {s for (s, _), n in notice.items() if n > 5}
    want = []
    for r in rows:
        if not base_counts(r[1])[5]:
            text = r[1]
            if r[3] in hot and text.startswith("the shared notice"):
                text = text.split("\n", 1)[1]
            want.append((r[0], text))
    assert Counter((r.doc_id, r.text) for r in quality) == Counter(want)
    assert all(r.n_chars == len(r.text) for r in quality)

    fps = [(r.doc_id, brute_fp(r.text)) for r in quality]
    names, at = brute_components(fps)
    reps = {names[a] for a in at}
    assert Counter(r.doc_id for r in deduped) == Counter({i: 1 for i in reps})

    assert {r.doc_id for r in redacted} == reps
    by = {r.doc_id: r.text for r in deduped}
    assert any(secrets.PLACEHOLDER in r.text for r in redacted)
    assert all(r.text == by[r.doc_id] or secrets.PLACEHOLDER in r.text for r in redacted)
    assert not any(re.search("[0-9a-f]{16}", r.text) for r in redacted)

    size = Counter()
    for r in redacted:
        size[r.source] += len(r.text.split())
    assert all(n <= 3 for n in Counter(r.doc_id for r in mixed).values())
    assert {r.doc_id: r.text for r in mixed}.items() <= {r.doc_id: r.text for r in redacted}.items()

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, encoded)) == Counter(
        (r.doc_id, len(ids := EXACT.encode_ordinary(r.text)), digest(",".join(map(str, ids))), digest(r.text)) for r in mixed
    )
    assert Counter(map(tuple, p.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, encoded))


def test_empty_table_and_extra_columns(spark, tmp_path):
    from data import SCHEMA

    names = ["size", "source_size", "doc", "h", "host", "text_key", "fp", "kind", "u", "row", "copies", "kept", "n"]
    rows = awkward_rows()[:16]
    more = [f"{i} as {c}" for i, c in enumerate(names)]
    for given in (frame(spark, rows), spark.createDataFrame([], SCHEMA)):
        docs = given.selectExpr("*", *more)
        for n, (name, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{given.count()}-{n}")
            out.write.parquet(path)
            if n < 4:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = spark.read.schema(out.schema).parquet(path)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (docs.count() > 0) == (given.count() > 0)
