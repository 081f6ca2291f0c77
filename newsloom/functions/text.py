"""Article text as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A text of fewer words is not substantial; fixed value of the ranking rules.
LEAST_WORDS = 150
#: What Python's ``\s`` takes for white space.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once a row, however often ``made`` uses it."""
    return F.element_at(F.transform(F.array(value), made), 1)


def normalise_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"(?U)\s+", " "))


def normalise_body(body: Column) -> Column:
    """Unix line ends, single spaces, no spaces around line ends, at most one blank line, stripped."""
    unix = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    spaced = F.regexp_replace(F.regexp_replace(unix, r"[\t\f\x0B ]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(spaced, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def word_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"\S+"))


def ruby_words(body: Column) -> Column:
    """Words between ASCII white space and null characters."""
    return F.regexp_count(body, F.lit(r"[^\x00\x09-\x0D\x20]+"))


def python_words(body: Column) -> Column:
    """Words between white space of any script."""
    return F.regexp_count(body, F.lit(f"[^{SPACE[1:-1]}]+"))


def bridge_body(body: Column) -> Column:
    """Single spaces, and lines without blank ones between or around."""
    spaced = F.regexp_replace(body, "[ \\t]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, f"{SPACE}*\\n{SPACE}*", "\n"), f"^{SPACE}+|{SPACE}+$", "")


def excerpt(body: Column, words: int = 55) -> Column:
    """The first words of a body."""
    return F.array_join(F.slice(F.filter(F.split(body, f"{SPACE}+"), lambda w: w != ""), 1, words), " ")


def authors(value: Column) -> Column:
    """Names from a byline that has commas or ``and`` between them."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"\s*(?:,| and )\s*"), lambda n: F.trim(n) != "")


def listed_authors(value: Column) -> Column:
    """Names from a record's authors (JSON text): a list as it is, a text like ``authors``, none for anything else."""
    parsed = F.try_parse_json(value)
    kind = F.coalesce(F.schema_of_variant(parsed), F.lit("VOID"))
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<string>"))
    return F.coalesce(listed, authors(F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string"))))


#: Phrases of pages behind an access wall: fixed values.
WALLS = ["subscribe to continue", "sign in to continue", "already a subscriber"]


def warnings(body: Column, page: Column) -> Column:
    """What an editor should know of a collected article: a short body, signs of an access wall."""
    wall = F.lower(page).rlike("|".join(WALLS))
    return F.array_compact(F.array(F.when(python_words(body) < LEAST_WORDS, "body_under_150_words"), F.when(wall, "possible_access_wall")))


def content_hash(body: Column, title: Column) -> Column:
    """SHA-256 of the canonical JSON of body and title."""
    return F.sha2(F.to_json(F.struct(body.alias("body_text"), title.alias("title")), {"ignoreNullFields": "false"}), 256)


def completeness(url: Column, body: Column) -> Column:
    return (
        F.when(F.contains(url, F.lit("/live/")), "live_page")
        .when(word_count(body) < LEAST_WORDS, "insufficient")
        .when(F.lower(body).contains("developing story"), "provisional")
        .otherwise("substantial")
    )


def completeness_local(url: Column, body: Column) -> Column:
    """As ``completeness``, for articles that were chosen by their number of words."""
    return F.when(F.contains(url, F.lit("/live/")), "live_page").when(
        F.lower(body).contains("developing story"),
        "provisional",
    ).otherwise("substantial")


def identity_prefix(url: Column) -> Column:
    """The first 20 hex digits of the SHA-256 of a URL: the name of an article's files."""
    return F.substring(F.sha2(url, 256), 1, 20)


def nfkc(text: Column) -> Column:
    """Unicode normalisation form NFKC; no built-in has it."""

    def form(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    def run(texts: pa.Array) -> pa.Array:
        # Few texts at a time stand in memory as Python strings.
        return pa.concat_arrays([form(texts.slice(i, 500)) for i in range(0, max(len(texts), 1), 500)])

    return F.arrow_udf(run, StringType())(text)


def first_words(text: Column, words: int) -> Column:
    """A beginning of ``text`` with its first words; after NFKC it still holds as many, as white space stays white space
    and nothing composes across it."""
    return F.array_join(F.slice(F.split(text, f"{SPACE}+", words + 2), 1, words + 1), " ")


def text_contract(title: Column, body: Column, words: int = 350) -> Column:
    """NFKC, squished title, blank line, and the first words of the body: what is embedded. Of a body only as much as
    that needs goes to Python."""
    squish = lambda c: F.trim(F.regexp_replace(nfkc(c), f"{SPACE}+", " "))
    begun = first_words(body, words)
    return F.concat(squish(title), F.lit("\n\n"), F.array_join(F.slice(F.split(squish(begun), " "), 1, words), " "))
