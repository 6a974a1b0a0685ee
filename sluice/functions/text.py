"""Text column functions (built-in expressions only, no Python UDF).

Each function has a DuckDB twin (``*_sql``) used by the oracles. Spark splits
on Unicode whitespace ``(?U)\\s`` like Python's ``str.split``; the oracle uses
RE2 ``\\s`` (ASCII). The test tables contain no non-ASCII blanks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.schemas import FALLBACK_TOPIC

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): keyword lists of categorize_text in
# priority order, the stop words and strip characters of extract_keywords.
HOW_TO_KEYWORDS = ["how to", "how do", "how can", "steps", "tutorial", "guide", "instruction", "method"]
DEFINITION_KEYWORDS = ["what is", "what are", "define", "definition", "meaning", "explain", "concept"]
TECHNOLOGY_KEYWORDS = ["software", "computer", "programming", "code", "app", "website", "internet", "digital",
                       "technology", "tech"]
SCIENCE_KEYWORDS = ["science", "biology", "chemistry", "physics", "research", "study", "experiment", "theory",
                    "scientific"]
STOP_WORDS = ["the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "for", "of",
              "as", "by"]
STRIP_CHARS = ".,?!:;"
MAX_KEYWORDS = 5
MIN_WORD_LEN = 3  # a word must be longer than this
# ---------------------------------------------------------------------------

DEFAULT_CATEGORIES: list[tuple[str, list[str]]] = [
    ("how_to", HOW_TO_KEYWORDS),
    ("definition", DEFINITION_KEYWORDS),
    ("technology", TECHNOLOGY_KEYWORDS),
    ("science", SCIENCE_KEYWORDS),
]

WS_SPLIT = r"(?U)\s+"


def words(c: Column) -> Column:
    """Whitespace tokens (Python ``str.split()``): no empty tokens."""
    return F.filter(F.split(c, WS_SPLIT), lambda w: w != "")


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: Unicode blanks and the separators U+001C..U+001F."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def strip_ws_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def content_key(title: Column, content: Column) -> Column:
    """sha256 hex of ``title|content`` stripped as a whole (cache key)."""
    return F.sha2(strip_ws(F.concat(title, F.lit("|"), F.coalesce(content, F.lit("")))), 256)


def content_key_sql(title: str, content: str) -> str:
    return f"sha256({strip_ws_sql(f'{title} || ' + chr(39) + '|' + chr(39) + f' || coalesce({content}, ' + chr(39) * 2 + ')')})"


def pair_key(title: Column, content: Column) -> Column:
    """Compact 128-bit key of the null-safe pair (title, content).

    Length-prefixed so that ('a|b', 'c') and ('a', 'b|c') differ and NULL differs
    from ''. Grouping and joining on 16 bytes instead of the full texts keeps
    the texts out of the aggregation shuffle.
    """
    def part(c: Column) -> Column:
        return F.concat(F.coalesce(F.length(c).cast("string"), F.lit("N")), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.unhex(F.md5(F.concat(part(title), F.lit(":"), part(content))))


def categorize_text(title: Column, content: Column,
                    categories: Sequence[tuple[str, Sequence[str]]] = DEFAULT_CATEGORIES,
                    default: str = "general") -> Column:
    """First category (in priority order) whose keyword is a substring."""
    full = F.lower(F.concat(title, F.lit(" "), F.coalesce(content, F.lit(""))))
    expr = None
    for name, kws in categories:
        cond = None
        for kw in kws:
            c = F.contains(full, F.lit(kw))
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def categorize_text_sql(title: str, content: str,
                        categories: Sequence[tuple[str, Sequence[str]]] = DEFAULT_CATEGORIES,
                        default: str = "general") -> str:
    full = f"lower({title} || ' ' || coalesce({content}, ''))"
    parts = []
    for name, kws in categories:
        cond = " OR ".join(f"contains({full}, '{kw}')" for kw in kws)
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


def extract_keywords(c: Column, stop_words: Sequence[str] = STOP_WORDS, k: int = MAX_KEYWORDS) -> Column:
    """Tokens longer than 3 and not stop words (tested before stripping), then
    stripped of ``.,?!:;``; the first ``k`` kept, duplicates kept."""
    stops = F.array(*[F.lit(s) for s in stop_words])
    kept = F.filter(words(F.lower(c)), lambda w: (F.length(w) > MIN_WORD_LEN) & ~F.array_contains(stops, w))
    return F.slice(F.transform(kept, lambda w: F.btrim(w, F.lit(STRIP_CHARS))), 1, k)


def extract_keywords_sql(x: str, stop_words: Sequence[str] = STOP_WORDS, k: int = MAX_KEYWORDS) -> str:
    stops = "[" + ", ".join(f"'{s}'" for s in stop_words) + "]"
    kept = f"list_filter({words_sql(f'lower({x})')}, lambda w: length(w) > {MIN_WORD_LEN} AND NOT list_contains({stops}, w))"
    return f"list_transform({kept}, lambda w: trim(w, '{STRIP_CHARS}'))[1:{k}]"


def extract_topic(title: Column) -> Column:
    """First title token longer than 3 characters (punctuation kept), else 'tema'."""
    cand = F.filter(words(F.lower(title)), lambda w: F.length(w) > MIN_WORD_LEN)
    return F.coalesce(F.try_element_at(cand, F.lit(1)), F.lit(FALLBACK_TOPIC))


def topic_sql(x: str) -> str:
    return (f"coalesce(list_filter({words_sql(f'lower({x})')}, lambda w: length(w) > {MIN_WORD_LEN})[1], "
            f"'{FALLBACK_TOPIC}')")


def template_text(template: Column, topic: Column) -> Column:
    return F.replace(template, F.lit("{topic}"), topic)


def token_count(c: Column) -> Column:
    """``len(answer.split())``."""
    return F.size(words(c))


def token_count_sql(x: str) -> str:
    return f"len({words_sql(x)})"


def char_count(c: Column) -> Column:
    return F.length(c)


def text_truncate(c: Column, n: int) -> Column:
    """Preview prefix (``title[:n]``)."""
    return F.substring(c, 1, n)
