import re
from collections import Counter

from data import SCHEMA, awkward_rows, frame
from skein.llm.quality import line_quality, without_frequent_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    marked = {j for i, x in enumerate(wins) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed)


def test_base_counts_match_brute_force(spark):
    rows = awkward_rows()
    rows += [(900, "a#b *c* $ %x& |y| <z>\n\n a#b *c* $", "en", "s", 1)]
    got = line_quality(frame(spark, rows)).collect()
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want


def test_shared_notice_goes_and_copies_stay(spark):
    notice = "subscribe to our letter for more of the same kind every single day of the week"
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(4000)]
    own = [" ".join(words[i * 60 : i * 60 + 60]) for i in range(30)]
    rows = [(i, notice + "\n" + own[i], "en", "host", 1) for i in range(12)]
    rows += [(100 + i, "\n".join([notice] * 4) + "\n" + own[20], "en", "host", 1) for i in range(1)]
    rows += [(200 + i, own[25], "en", "host", 1) for i in range(20)]
    docs = frame(spark, rows)
    v = line_quality(docs, copies_once=True)
    got = {r.doc_id: r for r in v.collect()}
    assert all(got[i].kept and got[i].removed_words == 16 for i in range(12))
    assert not got[100].kept
    assert all(got[200 + i].kept and got[200 + i].removed_words == 0 for i in range(20))
    left = {r.doc_id: r.text for r in without_frequent_lines(docs, v).collect()}
    assert left[3] == own[3] and left[205] == own[25] and 100 not in left


def test_copies_of_one_page_do_not_shield_a_notice_on_others(spark):
    notice = "subscribe to our letter for more of the same kind every single day of the week"
    words = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(1000)]
    own = [" ".join(words[i * 60 : i * 60 + 60]) for i in range(16)]
    rows = [(i, notice + "\n" + own[i], "en", "host", 1) for i in range(12)]
    rows += [(100 + i, notice + "\n" + own[15], "en", "host", 1) for i in range(40)]
    got = {r.doc_id: r for r in line_quality(frame(spark, rows), copies_once=True).collect()}
    assert all(got[i].removed_words == 16 for i in range(12))
    assert all(got[100 + i].removed_words == 0 and got[100 + i].kept for i in range(40))


def brute_removed(rows, line_docs=5):
    """Words on lines that more than ``line_docs`` documents of a host hold, per row."""
    norm = lambda x: re.sub("[0-9]", "0", " ".join(WORD.findall(x)).lower())
    lines = [[norm(x) for x in (r[1] or "").split("\n") if WORD.search(x)] for r in rows]
    holders = {}
    for r, own in zip(rows, lines):
        for x in own:
            holders.setdefault((r[3], x), set()).add(r[0] if r[0] is not None else r[1])
    return [sum(len(x.split(" ")) for x in own if len(holders[r[3], x]) > line_docs) for r, own in zip(rows, lines)]


def test_verdicts_match_brute_force(spark):
    rows = awkward_rows()
    long_text = "\n".join("line %d of the long text" % (i % 9000) for i in range(40_000))
    rows += [(500 + i, "a line of many\n" + rows[i % 9][1], "en", "h", 1) for i in range(9)] + [(700 + i, long_text, "en", "h", 1) for i in range(7)]
    rows += [(None, "a line of many\nwithout an id", "en", "h", 1)] * 3
    removed = brute_removed(rows)
    want = Counter((r[0], n, not (b := brute(r[1]))[5] and n <= 0.5 * b[0]) for r, n in zip(rows, removed))
    assert Counter((r.doc_id, r.removed_words, r.kept) for r in line_quality(frame(spark, rows)).collect()) == want


def test_repeated_rows_count_as_one_document(spark):
    rows = [(i, "this line is held by four documents\n" + "w%d " % i * 60, "en", "h", 1) for i in range(4)]
    for copies_once in (False, True):
        assert not any(r.removed_words for r in line_quality(frame(spark, rows * 3), copies_once=copies_once).collect())
    rows += [(9 + i, "this line is held by four documents\n" + "v%d " % i * 60, "en", "h", 1) for i in range(2)]
    assert {r.removed_words for r in line_quality(frame(spark, rows * 2)).collect()} == {7}


def test_empty_and_extra_columns(spark):
    assert line_quality(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = frame(spark).selectExpr("*", "1 as h", "2 as host", "3 as f_h", "4 as n", "5 as m", "6 as who", "7 as lines")
    assert line_quality(docs).count() == len(awkward_rows())
