"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy as P


def normalize_text(c: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" "))


def normalize_label(c: Column) -> Column:
    """Lower case; other runs than letters, digits and ._/- become a dash; one dash is stripped at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(normalize_text(c)), r"[^a-z0-9._/-]+", "-"), r"^-|-$", "")


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("long")


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case tokens of at least so many characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"([a-z0-9_./:-]{{{least},}})"), F.lit(1)))


def files(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({P.FILE_PATTERN})"), F.lit(1)))


def without_files(c: Column) -> Column:
    return F.regexp_replace(c, P.FILE_PATTERN, " ")


def document_name(v: Column) -> Column:
    return v.rlike(P.DOCUMENT_NAME) & F.contains(v, F.lit("_")) & ~v.rlike(r"\d")


def symbols(c: Column) -> Column:
    """Distinct names of code of a text without its files: in backticks, by suffix, in Pascal case, and called, less words that are none."""
    return symbols_without_files(without_files(c))


def symbols_without_files(own: Column) -> Column:
    """As symbols, of a text that files are taken out of; a column of its own is computed once, an expression once for each pattern."""
    every = lambda pattern: F.regexp_extract_all(own, F.lit(pattern), F.lit(1))
    spans = F.filter(every(P.CODE_SPAN), lambda v: v.rlike(P.NAME_SHAPE) & (v.rlike(P.NAME_STRUCTURE) | v.rlike(P.NAME_HUMP)))
    pascal = F.filter(every(P.PASCAL_PATTERN), lambda v: ~document_name(v) & (v.rlike("[0-9_]") | (v.rlike("[a-z]") & F.substring(v, 2, 1 << 20).rlike("[A-Z]"))))
    found = F.array_distinct(F.concat(spans, every(f"({P.SYMBOL_PATTERN})"), pascal, every(P.CALL_PATTERN)))
    sentence = F.regexp_extract(own, P.FIRST_SENTENCE, 0)
    sentence = F.when(sentence == "", own).otherwise(sentence)
    elsewhere = lambda v: v.isin(*P.VERBS_OF_PROMPTS) & ~F.regexp_like(sentence, F.concat(F.lit(r"\b"), v, F.lit(r"\b")))
    return F.filter(found, lambda v: ~v.isin(*P.NO_SYMBOLS, *P.NO_SYMBOLS_OF_TASKS) | elsewhere(v))


def errors(c: Column) -> Column:
    """Distinct names, codes and numbers of errors of a text without its files."""
    return errors_without_files(without_files(c))


def errors_without_files(own: Column) -> Column:
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(own, F.lit(p), F.lit(1)) for p in P.ERROR_PATTERNS]))
    return F.filter(found, lambda v: ~document_name(v))


def terms_in(c: Column, terms: tuple[str, ...]) -> Column:
    """Those of terms that stand in the text as whole words, in the order of terms."""
    return F.filter(F.array(*[F.when(F.lower(c).rlike(P.TERM_PATTERNS.get(t, rf"\b{t}\b")), F.lit(t)) for t in terms]), lambda x: x.isNotNull())


def hints_in(c: Column, hints: tuple[str, ...]) -> Column:
    """Those of hints that stand anywhere in the text, in the order of hints."""
    return F.filter(F.array(*[F.when(F.contains(F.lower(c), F.lit(t)), F.lit(t)) for t in hints]), lambda x: x.isNotNull())


def compounds(c: Column) -> Column:
    """Words of five characters or more joined by dashes or underscores."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({P.COMPOUND_PATTERN})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.length(x) >= 5))


def quoted(c: Column) -> Column:
    """What stands in double or single quotes, 3 to 80 characters."""
    found = F.regexp_extract_all(c, F.lit("\"[^\"]{3,80}\"|'[^']{3,80}'"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.substr(x, F.lit(2), F.length(x) - 2)))


def uuids(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({P.UUID_PATTERN})"), F.lit(1)), F.lower))


def lexical_terms(c: Column, exact: Column, most: int = 32) -> Column:
    """Terms of a lexical query: the exact ones first, then the words of three characters or more that are no stop words, in order."""
    words = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_./:-]{3,})"), F.lit(1)), lambda x: ~x.isin(*P.STOP_WORDS))
    return F.slice(F.array_distinct(F.concat(exact, words)), 1, most)


def domain(found: Column) -> Column:
    """The folder below src/ of the first file that has one."""
    hits = F.filter(F.transform(found, lambda f: F.lower(F.regexp_extract(f, r"(?i)^src/([a-z][\w-]+)/", 1))), lambda d: d != "")
    return F.get(hits, F.lit(0))


def task_type(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda w, tp: w.when(low.rlike(tp[1]), tp[0]), P.TASK_PATTERNS, F.when(F.lit(False), "")).otherwise("unknown")


def confidence(n_signals: Column) -> Column:
    return F.least(F.lit(0.96), 0.2 + n_signals * 0.1)


def length_class(c: Column) -> Column:
    return F.when(F.length(c) >= P.LENGTH_LONG, "long").when(F.length(c) >= P.LENGTH_MEDIUM, "medium").otherwise("short")


REDACTED = "[REDACTED:secret]"


def no_credential(value: Column, before: Column) -> Column:
    """Whether the value of an assignment is none: a placeholder, a name of a type, of three different characters at most, or in a comment. before: the text up to the match."""
    bare = F.regexp_replace(value, "^[\"']|[\"']$", "")
    kind = F.btrim(F.regexp_replace(bare, r"[,;:)}\]>]+$", ""))
    placeholder = reduce(lambda a, p: a | F.btrim(bare).rlike(p), P.PLACEHOLDER_PATTERNS, F.length(F.btrim(bare)) == 0)
    return F.substring_index(before, "\n", -1).rlike(P.COMMENT_PATTERN) | placeholder | kind.rlike(P.TYPE_PATTERN) | (F.size(F.array_distinct(F.split(bare, ""))) <= 3)


def _redact_assignments(c: Column, pattern: str) -> Column:
    hits, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern)
    start = F.struct(F.lit("").alias("old"), F.lit("").alias("new"))

    def step(a, x):
        before = F.concat(a["old"], x["gap"])
        kept = F.when(no_credential(F.regexp_extract(x["hit"], pattern, 1), before), x["hit"]).otherwise(REDACTED)
        return F.struct(F.concat(before, x["hit"]).alias("old"), F.concat(a["new"], x["gap"], kept).alias("new"))

    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    return F.when(F.size(hits) == 0, c).otherwise(F.concat(F.aggregate(pairs, start, step)["new"], F.element_at(gaps, -1)))


def redact_secrets(c: Column) -> Column:
    """The patterns in order, each applied to what the ones before left; assignments only where the value may be a credential."""
    return reduce(lambda t, np: _redact_assignments(t, np[1]) if np[0] == "credential_assignment" else F.regexp_replace(t, np[1], REDACTED), P.SECRET_PATTERNS, c)


def redact_pii(c: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), (P.EMAIL_PATTERN, P.PHONE_PATTERN, P.IPV4_PATTERN), c)


def fence_share(c: Column) -> Column:
    """Share of a text's lines that stand in code fences, the fences included."""
    lines = F.split(c, r"\r?\n")
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("n"))

    def step(a, x):
        fence = x.rlike(r"^\s{0,3}```")
        return F.struct(F.when(fence, ~a["open"]).otherwise(a["open"]).alias("open"), (a["n"] + (fence | a["open"]).cast("int")).alias("n"))

    return F.aggregate(lines, start, step)["n"] / F.size(lines)


def truncate_utf8(c: Column, most: int, mark: str = "\n[truncated]") -> Column:
    """c, if longer than most bytes cut by fifths of its characters until it fits together with the mark."""
    room = most - len(mark.encode())
    sizes = F.transform(F.sequence(F.lit(0), F.lit(120)), lambda _: F.lit(0.8))
    cut = F.aggregate(sizes, c, lambda a, f: F.when(F.octet_length(a) > room, F.substr(a, F.lit(1), F.floor(F.length(a) * f).cast("int"))).otherwise(a))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(cut, F.lit(mark)))


def same_signal(a: Column, b: Column) -> Column:
    return normalize_label(a) == normalize_label(b)


def area_key(path: Column) -> Column:
    """Area of a path: src/<folder>, the first folder, _root or _unassigned."""
    s = F.filter(F.split(F.regexp_replace(path, r"^\./", ""), "/"), lambda x: x != "")
    first = F.get(s, F.lit(0))
    return F.when(F.size(s) == 0, "_unassigned").when(F.size(s) == 1, "_root").when(first == "src", F.when(F.size(s) >= 3, F.concat(F.lit("src/"), F.get(s, F.lit(1)))).otherwise("src")).otherwise(first)


def area_label(key: Column) -> Column:
    last = F.element_at(F.split(key, "/"), -1)
    return F.when(key == "_root", "Root").when(key == "_unassigned", "Unassigned").otherwise(F.concat(F.upper(F.substring(last, 1, 1)), F.substring(last, 2, 1 << 20)))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, max(0, most - 3))), F.lit("...")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def fingerprint_error(message: Column) -> Column:
    """SHA-256 of a message with hexadecimal runs and numbers masked."""
    masked = F.regexp_replace(F.regexp_replace(F.lower(message), r"0x[0-9a-f]+|\b[0-9a-f]{8,}\b", "<hex>"), r"\d+", "<n>")
    return F.sha2(F.substring(normalize_text(masked), 1, 240), 256)


def hash_index(token: Column, dim: int) -> Column:
    """Index and sign of a token in a hash embedding: first four bytes of its SHA-256, parity of the fifth."""
    h = F.sha2(token, 256)
    at = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return F.struct(at.alias("at"), sign.alias("sign"))
