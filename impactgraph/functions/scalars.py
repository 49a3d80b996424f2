"""Scalar rules on paths, names, texts and evidence, as column expressions.

Lengths are UTF-8 bytes wherever a token estimate or a size is meant; texts are cut on characters, so that no character is
split. Missing values are the type's zero value: "", 0, false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edge kinds, those that express a dependency, and evidence tiers from strongest to weakest.
EDGE_KINDS = ("calls", "uses-type", "implements", "extends", "overrides", "contains", "defines", "imports")
DEPENDENCY_KINDS = ("calls", "imports", "uses-type", "implements", "extends")
TIERS = ("precise", "measured", "structural", "heuristic")

# Bytes per token, clamped line length, and cut lengths.
BYTES_PER_TOKEN = 4
MAX_LINE_BYTES = 1200
MAX_HIT_CHARS = 250


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Estimated tokens of a text: a fourth of its bytes, at least 1 unless it is empty."""
    n = F.octet_length(text_or_empty(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / BYTES_PER_TOKEN))).cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def display_name(qualified: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(qualified, F.lit("")), name)


def reference(kind: Column, shown: Column, file: Column, line: Column) -> Column:
    return F.concat(kind, F.lit(" "), shown, F.lit(" ("), file, F.lit(":"), line.cast("string"), F.lit(")"))


def leaf(name: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(name, r"\."), -1)


def directory(path: Column) -> Column:
    """The directory part, `.` when there is none."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), F.when(cut == "", F.lit("/")).otherwise(cut)).otherwise(F.lit("."))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(base: Column) -> Column:
    return F.regexp_extract(base, r"(\.[^.]*)$", 1)


def component(path: Column, depth: int = 0) -> Column:
    """The component of a file: its directory, of which `depth` segments are kept if depth is not 0."""
    d = directory(path)
    cut = F.array_join(F.slice(F.split(d, "/"), 1, depth), "/") if depth else d
    return F.when(d.isin(".", "/", ""), F.lit("(root)")).otherwise(cut)


def tier(source: Column) -> Column:
    return F.when(source == "native", "precise").when(source == "astkit", "measured").when(source == "tree_sitter", "structural").otherwise("heuristic")


def tier_rank(t: Column) -> Column:
    """0 for the strongest; unknown tiers rank as the weakest."""
    out = F.lit(len(TIERS) - 1)
    for i, name in enumerate(TIERS):
        out = F.when(t == name, F.lit(i)).otherwise(out)
    return out


def tier_of_rank(r: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*map(F.lit, TIERS)), r + 1), F.lit(TIERS[-1]))


# Four test rules follow; they answer different questions and disagree on purpose.


def is_test_double(path: Column) -> Column:
    """A test file or a stand-in: ranked below real symbols in lookups, left out of call neighbours."""
    p = F.lower(path)
    return p.endswith("_test.go") | p.contains("mock") | p.contains("fake") | p.contains("stub") | p.contains("/testdata/")


def is_view_test(path: Column) -> Column:
    """A test file in the component view."""
    p = F.lower(path)
    base = base_name(p)
    ext = extension(base)
    stem = F.when(ext == "", base).otherwise(F.substring(base, F.lit(1), F.length(base) - F.length(ext)))
    folders = F.array(*map(F.lit, ("test", "tests", "__tests__", "testdata", "spec", "specs")))
    named = stem.endswith("_test") | stem.endswith(".test") | stem.endswith(".spec") | stem.endswith("_spec") | stem.startswith("test_") | (base == "conftest.py")
    return F.arrays_overlap(F.split(directory(p), "/"), folders) | named | (ext.isin(".java", ".cs", ".kt") & (stem.endswith("test") | stem.endswith("tests")))


def is_verify_test(path: Column) -> Column:
    """A test file in completeness checks; case matters here."""
    base = base_name(path)
    out = base.endswith("_test.go") | base.startswith("test_") | base.contains(".test.") | base.contains(".spec.")
    return out | path.contains("/test/") | path.contains("/tests/") | path.contains("/__tests__/") | path.contains("src/test/")


def is_category_test(path: Column) -> Column:
    """A test file when symbols are sorted into budget categories."""
    p = F.lower(path)
    inner = F.lit(False)
    # Parts and endings of test paths.
    for part in ("_test.", ".test.", ".spec.", "/__tests__/", "/tests/", "/test/"):
        inner = inner | p.contains(part)
    for end in ("_test.py", "test.java", "tests.java", "_test.rs", "tests.rs", "_test.c", "_test.h", "_test.cc", "_test.cpp", "test.cs", "tests.cs", "test.php", "tests.php"):
        inner = inner | p.endswith(end)
    return inner


def is_markdown_const(raw: Column) -> Column:
    """A constant that holds markdown: five line breaks and three structural lines at least."""
    trimmed = F.transform(F.split(raw, "\n", -1), F.trim)
    marks = F.filter(trimmed, lambda s: s.startswith("##") | s.startswith("|---") | s.startswith("| ---") | (s.startswith("- ") & (F.octet_length(s) > 4)))
    return (F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit(""))) >= 5) & (F.size(marks) >= 3)


def category(path: Column, kind: Column, docstring: Column, signature: Column, raw: Column) -> Column:
    return (
        F.when(is_category_test(path), "test")
        .when((kind == "namespace") | F.lower(path).endswith(".md"), "doc")
        .when((docstring != "") & (signature == ""), "doc")
        .when((kind == "const") & is_markdown_const(raw), "doc")
        .otherwise("dependency")
    )


def is_trivial(kind: Column, start: Column, end: Column, calls: Column) -> Column:
    """A body of at most eight lines below its first that calls nothing."""
    return (end > start) & (end - start <= 8) & (calls == 0) & kind.isin("function", "method", "constructor")


def summarize(c: Column, most: int) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def hit_line(c: Column) -> Column:
    """A matched line as it is shown: without a trailing carriage return, cut to MAX_HIT_CHARS."""
    t = F.regexp_replace(c, "\r$", "")
    return F.when(F.length(t) > MAX_HIT_CHARS, F.concat(F.left(t, F.lit(MAX_HIT_CHARS)), F.lit("…"))).otherwise(t)


def clamp_lines(c: Column) -> Column:
    """Lines of over MAX_LINE_BYTES are cut, and say how long they were."""
    def cut(s: Column) -> Column:
        note = F.concat(F.lit("… [line truncated: "), F.octet_length(s).cast("string"), F.lit(" bytes]"))
        return F.when(F.octet_length(s) > MAX_LINE_BYTES, F.concat(F.left(s, F.lit(MAX_LINE_BYTES)), note)).otherwise(s)

    return F.when(F.octet_length(c) <= MAX_LINE_BYTES, c).otherwise(F.array_join(F.transform(F.split(c, "\n", -1), cut), "\n"))


def contains_word(text: Column, word: str) -> Column:
    """Whole-word match, whatever the case; a word's neighbours are no letter, digit or underscore."""
    return text.rlike(r"(?i)(?<![\p{L}\p{N}_])" + re.escape(word) + r"(?![\p{L}\p{N}_])")


def pattern(term: str, regex: bool = False, whole_word: bool = False) -> str:
    """A case-insensitive Java pattern; a regex that doesn't compile is taken literally."""
    if regex:
        try:
            re.compile(term)
        except re.error:
            regex = False
    body = term if regex else re.escape(term)
    return r"(?i)" + (rf"\b(?:{body})\b" if whole_word else body)


def glob_regex(glob: str) -> str:
    """A glob over one path: `*` and `?` stay within a segment, [...] is a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out += "[" + glob[i + 1 : j].replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_component(pat: Column, glob: Column, comp: Column) -> Column:
    """Whether a rule's side covers a component: all, itself, what lies below it, or by glob (given as a regex)."""
    return (pat == "*") | (pat == comp) | F.startswith(comp, F.concat(pat, F.lit("/"))) | F.regexp_like(comp, glob)


def indent_width(line: Column) -> Column:
    """Width of the leading white space, tabs as four."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    return F.length(F.replace(lead, F.lit("\t"), F.lit("    ")))


def short_sha(c: Column) -> Column:
    return F.left(c, F.lit(8))


def repository_key(root: str) -> str:
    import hashlib

    return hashlib.sha1(root.encode()).hexdigest()[:16]


# Name fragments of models, in order of precedence, and their context windows in tokens.
CONTEXT_WINDOWS = (("gemini-1.5", 1_000_000), ("gemini-2", 1_000_000), ("gemini", 128_000), ("claude", 200_000), ("gpt-4", 128_000), ("o1", 128_000), ("o3", 128_000), ("gpt-3", 16_000))


def context_window(model: Column) -> Column:
    """Tokens of a model's window by its name; 128,000 for unknown names and 200,000 for none."""
    m = F.lower(F.trim(text_or_empty(model)))
    out = F.lit(128_000)
    for part, size in reversed(CONTEXT_WINDOWS):
        out = F.when(m.contains(part), size).otherwise(out)
    return F.when(m == "", 200_000).otherwise(out)


# Extensions by the tag of their fenced code.
LANGUAGE_TAGS = {"go": (".go",), "python": (".py",), "typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "java": (".java",), "ruby": (".rb",), "rust": (".rs",), "c": (".c", ".h"), "cpp": (".cc", ".cpp", ".hpp"), "csharp": (".cs",), "php": (".php",), "bash": (".sh",)}


# What begins a line comment, by extension; elsewhere nothing does.
COMMENTS = {"//": (".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".java", ".rs", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".php", ".kt", ".swift", ".scala"), "#": (".py", ".rb", ".sh", ".yaml", ".yml", ".toml"), "--": (".sql", ".lua")}


def comment_prefix(path: Column) -> Column:
    ext = extension(F.lower(base_name(path)))
    out = F.lit("")
    for mark, exts in COMMENTS.items():
        out = F.when(ext.isin(*exts), mark).otherwise(out)
    return out


def language_tag(path: Column) -> Column:
    ext = extension(F.lower(base_name(path)))
    out = F.lit("")
    for tag, exts in LANGUAGE_TAGS.items():
        out = F.when(ext.isin(*exts), tag).otherwise(out)
    return out
