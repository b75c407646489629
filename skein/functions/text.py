"""Scalar text functions as columns; all run in the JVM unless said otherwise."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_ALNUM = r"[^\p{L}\p{N}]+"


def make_id(*parts: Column) -> Column:
    """A stable id from parts: empty ones dropped, edges trimmed of ``_.``, other runs one ``_``, lower case."""
    trimmed = F.array(*[F.btrim(p, F.lit("_.")) for p in parts])
    joined = F.array_join(F.filter(trimmed, lambda p: p != ""), "_")
    return F.lower(F.btrim(F.regexp_replace(joined, _NO_ALNUM, "_"), F.lit("_")))


def norm_label(label: Column) -> Column:
    """Lower case without combining marks."""
    return F.regexp_replace(F.lower(label), "[\\u0300-\\u036f]", "")


def norm(label: Column) -> Column:
    """Lower case, camel and punctuation boundaries aside: runs of non-alphanumerics become one space."""
    return F.btrim(F.regexp_replace(F.lower(label), _NO_ALNUM, " "))


def search_tokens(text: Column) -> Column:
    r"""Split at ``_ . : / \ -``, blanks and lower-to-upper camel boundaries; lower case."""
    camel = F.regexp_replace(text, r"([^\p{Lu}_.:/\\\s-])(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(camel), r"[_.:/\\\s-]+"), lambda t: t != "")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text. One pass over a text, in Arrow batches."""
    import pandas as pd

    def run(texts):
        out = []
        for t in texts:
            total = 0.0
            for n in Counter(t or "").values():
                total -= n / len(t) * math.log2(n / len(t))
            out.append(None if t is None else total)
        return pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(text)


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct k-character windows without blanks; a shorter text is one window. Work grows with the text, not its square."""
    t = F.regexp_replace(text, r"\s+", "")
    chars = F.split(t, "")  # no lambda below names it, which would split once a window
    n = F.length(t)
    windows = reduce(lambda w, j: F.zip_with(w, F.slice(chars, j + 1, F.greatest(n, F.lit(1))), lambda x, y: F.concat(x, y)), range(1, k), chars)
    return F.when(n < k, F.array(t)).otherwise(F.array_distinct(F.slice(windows, 1, F.greatest(n - (k - 1), F.lit(1)))))


def extract_between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``; null without them."""
    a = F.locate(start, text)
    rest = F.substr(text, a + len(start))
    b = F.locate(end, rest)
    return F.when((a > 0) & (b > 0), F.substr(rest, F.lit(1), b - 1))


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags removed, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, "<[^>]+>", "")
    t = F.regexp_replace(t, "[ \t]+", " ")
    return F.btrim(F.regexp_replace(t, "\n{3,}", "\n\n"))


def sanitize_filename(name: Column) -> Column:
    """Scheme off, separators to ``_``, only letters, digits and ``_-.``, 80 characters."""
    t = F.regexp_replace(name, "^https?://", "")
    t = F.translate(t, "/?&=# ", "______")
    return F.substring(F.regexp_replace(t, r"[^\p{L}\p{N}_.-]", ""), 1, 80)


def html_escape(text: Column) -> Column:
    """``& < > " '`` as entities."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


xml_escape = html_escape


def cypher_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def js_escape(text: Column) -> Column:
    return _replaced(text, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def redis_escape(text: Column) -> Column:
    """For a double-quoted argument; a Cypher statement is escaped for Cypher first."""
    return _replaced(text, ("\\", "\\\\"), ('"', '\\"'))


def yaml_quote(text: Column) -> Column:
    """A double-quoted scalar on one line."""
    return F.concat(F.lit('"'), _replaced(text, ("\\", "\\\\"), ('"', '\\"'), ("\n", " "), ("\r", " ")), F.lit('"'))


def mermaid_escape(text: Column) -> Column:
    """What a diagram reads as syntax goes, arrows become words, the rest is escaped for HTML."""
    plain = F.regexp_replace(_replaced(text, ('"', "'"), ("|", " ")), "[`#{}]", "")
    return html_escape(F.btrim(F.regexp_replace(F.regexp_replace(plain, "-?->>?", " to "), r"\s+", " ")))


def sanitize_label(label: Column) -> Column:
    """Control characters dropped, 256 characters, escaped."""
    return html_escape(F.substring(F.regexp_replace(label, r"\p{Cntrl}", ""), 1, 256))


def link_targets(text: Column) -> Column:
    """Relative link targets of a markdown text: inline, reference and wiki links."""
    inline = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(\s*<?([^)\s>]+)"), F.lit(1))
    reference = F.regexp_extract_all(text, F.lit(r"(?m)^\s{0,3}\[[^\]]+\]:\s*<?([^\s>]+)"), F.lit(1))
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    cut = F.transform(F.concat(inline, reference, wiki), lambda t: F.replace(F.regexp_replace(t, "[#?].*$", ""), F.lit("%20"), F.lit(" ")))
    return F.array_distinct(F.filter(cut, lambda t: (t != "") & ~t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~t.startswith("//")))


#: Tags that mark a rationale comment.
RATIONALE_TAGS = ("NOTE", "IMPORTANT", "HACK", "WHY", "RATIONALE", "TODO", "FIXME")
#: Line comment markers by language.
COMMENT_MARKERS = {
    "python": ("#",), "ruby": ("#",), "shell": ("#",), "yaml": ("#",), "rust": ("//",), "go": ("//",), "java": ("//",), "javascript": ("//",),
    "typescript": ("//",), "c": ("//", "/*", "*"), "cpp": ("//", "/*", "*"), "csharp": ("//",), "kotlin": ("//",), "sql": ("--",), "lua": ("--",),
}


def rationale(line: Column, language: str) -> Column:
    """``TAG: text`` of a rationale comment line, 80 characters; null for others."""
    marker = "|".join("\\Q" + m + "\\E" for m in COMMENT_MARKERS[language])
    tags = "|".join(RATIONALE_TAGS)
    found = F.regexp_extract(line, rf"(?:{marker})+\s*((?:{tags}):.*)$", 1)
    return F.when(found != "", F.substring(F.btrim(found), 1, 80))


def document_references(text: Column) -> Column:
    """Distinct decision-record and standards citations in canonical form."""
    adr = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bADR[-\s]?0*(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("ADR-"), F.lpad(n, 4, "0")))
    rfc = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bRFC[-\s]?0*(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("RFC "), n))
    return F.array_distinct(F.concat(adr, rfc))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def word_token_estimate(words: Column) -> Column:
    return F.ceil(words * 1.3)


def file_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def normalize_path(path: Column) -> Column:
    """``.`` and ``..`` resolved by text alone."""

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when(F.coalesce(up, F.lit(False)), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def path_match(a: Column, b: Column) -> Column:
    """Equal, or one a suffix of the other at a segment boundary."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


#: Directories, name beginnings, name endings and infixes of test files.
TEST_DIRS = ("tests", "__tests__", "test", "spec")
TEST_BEGINNINGS = ("test_", "tests_")
TEST_ENDINGS = ("_test.go", "_test.py", "_test.rs", "_test.rb", "_spec.rb", "_test.dart", "_test.swift", "_test.kt", "_test.scala")
TEST_INFIXES = (".test.", ".spec.")


def is_test_file(path: Column) -> Column:
    """Whether a path names a test, case aside; a directory counts below another one."""
    either = lambda words: "|".join(re.escape(w) for w in words)
    rule = f"/({either(TEST_DIRS)})/|(^|/)({either(TEST_BEGINNINGS)})[^/]*$|({either(TEST_ENDINGS)})$|({either(TEST_INFIXES)})[^/]*$"
    return F.lower(path).rlike(rule)


def glob_regex(pattern: str) -> str:
    """A regular expression for ``*``, ``?`` and ``**``."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] != "_" else pattern[i]), i + 1
    return f"^{out}$"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a glob matches the path, its name or one of its segments."""
    tests = []
    for p in patterns:
        r = glob_regex(p.rstrip("/"))
        tests.append(path.rlike(r) | F.exists(F.split(path, "/"), lambda s, r=r: s.rlike(r)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


#: Address ranges that must not be fetched, as (first address, prefix length).
BLOCKED_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.168.0.0", 16), ("198.18.0.0", 15), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def _packed(host: Column) -> Column:
    """An IPv4 host, dotted, decimal or hexadecimal, as a number; null for names."""
    q = F.transform(F.split(host, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("long"))
    dotted = F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return (
        F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), dotted)
        .when(host.rlike(r"^\d{5,10}$"), host.try_cast("long"))
        .when(host.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(host, 3, 8), 16, 10).cast("long"))
    )


def is_safe_url(url: Column) -> Column:
    """http(s) to a public host: no loopback, private, shared, link-local, benchmark or multicast address."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^@/]*@)?(\[[^\]]*\]|[^:/?#]+)", 1))
    ip = _packed(host)
    blocked = F.lit(False)
    for first, bits in BLOCKED_RANGES:
        n = sum(int(x) << (24 - 8 * i) for i, x in enumerate(first.split(".")))
        blocked = blocked | F.coalesce(F.shiftrightunsigned(ip, 32 - bits) == (n >> (32 - bits)), F.lit(False))
    named = host.rlike(r"^(localhost|.*\.localhost|.*\.local|.*\.internal)$") | host.rlike(r"^\[(::1?|f[cd].*|fe80.*)\]$")
    return (host != "") & ~blocked & ~named


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def decay(age_days: Column, half_life: float = 30.0) -> Column:
    """0.5 to the age in half-lives; a negative age counts as 0."""
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def human_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """Bytes in units of 1024 with one decimal, a tie to the even one; whole bytes below, the last unit from there on."""
    out = F.format_string("%d B", n.cast("long"))
    for i, unit in enumerate(units, 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**i), 1))).otherwise(out)
    return out


def version_key(text: Column) -> Column:
    """A sortable key of N[.N[.N]] with an optional leading v and a tag after a dash, which sorts below none; null for others."""
    core = F.regexp_replace(F.regexp_replace(F.btrim(text), "^v+", ""), r"\+.*$", "")
    whole = r"^([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-(.+))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(core, whole, i), F.lit("")).cast("long"), F.lit(0))
    tag = F.regexp_extract(core, whole, 4)
    return F.when(core.rlike(whole), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (tag == "").alias("final"), tag.alias("tag")))


def within_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes."""
    chars = F.filter(F.split(F.substring(text, 1, most), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"), F.lit(True).alias("open"))

    def step(acc: Column, c: Column) -> Column:
        n = acc["n"] + F.octet_length(c)
        fits = acc["open"] & (n <= most)
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), F.when(fits, F.concat(acc["t"], c)).otherwise(acc["t"]).alias("t"), fits.alias("open"))

    return F.when(F.octet_length(text) <= most, text).otherwise(F.aggregate(chars, start, step)["t"])


def fnv_digest(text: Column) -> Column:
    """The upper half of the 64-bit FNV-1a hash of the UTF-8 bytes as eight hexadecimal digits."""
    import pandas as pd

    def run(texts):
        out = []
        for t in texts:
            h = 0xCBF29CE484222325
            for b in (t or "").encode():
                h = (h ^ b) * 0x100000001B3 % (1 << 64)
            out.append(f"{h >> 32:08x}")
        return pd.Series(out)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(text)


def salvaged_pairs(text: Column) -> Column:
    """Map of number to name from a model's answer: fences and prose around the pairs do not matter; names of 80 characters."""
    pair = r'"?([0-9]+)"?\s*:\s*"((?:[^"\\]|\\.)*)"'
    keys, names = F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.regexp_extract_all(text, F.lit(pair), F.lit(2))
    tidy = F.transform(names, lambda n: F.substring(F.btrim(F.regexp_replace(F.regexp_replace(n, r'\\(.)', "$1"), r"\s+", " ")), 1, 80))
    rows = F.filter(F.arrays_zip(F.transform(keys, lambda k: k.cast("int")).alias("k"), tidy.alias("n")), lambda r: r["n"] != "")
    first = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, 1, i), lambda q: q["k"] == r["k"]))
    return F.map_from_entries(first)


def quote_identifier(name: Column) -> Column:
    """A lower-case SQL identifier as it is, any other in double quotes."""
    return F.when(name.rlike("^[a-z_][a-z0-9_]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))
