"""Text as Column expressions. The classes are chosen so that Java, Python and RE2 regular expressions agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: White space that is not one space already.
SPACES = r"\s{2,}|[\t\n\x0B\f\r]"
URL = r"https?://[!$-_a-z]+"
HASHTAG = r"#([\p{L}\p{N}_]+)"
MENTION = r"@([\p{L}\p{N}_]+)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9() .-]{7,}[0-9]"
#: Emoji blocks; the wide set also covers CJK, Kana and Hangul, as older cleaners do.
EMOJI_STRICT = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{24C2}]"
EMOJI_COMPAT = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]"
# Emoji and the tokens that stand for them.
EMOJI_TOKENS = {
    "🔥": "FIRE", "❤️": "HEART", "😂": "LAUGHING", "👍": "THUMBS_UP", "👎": "THUMBS_DOWN", "🎉": "CELEBRATION", "💯": "HUNDRED", "✨": "SPARKLES",
    "🚀": "ROCKET", "⚡": "LIGHTNING", "💡": "BULB", "🤔": "THINKING", "😊": "SMILING", "😢": "CRYING", "😡": "ANGRY",
}
# Words that keyword counts leave out.
STOP_KEYWORDS = "the is at which on a an and or but in with to for of as by".split()
STOP_LABELS = "the this that with from have what when where which their there these those would could should".split()
STOP_COHERENCE = [*STOP_KEYWORDS, *"this that from are was were been have has".split()]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group))


def urls(text: Column | str) -> Column:
    return all_matches(text, URL)


def hashtags(text: Column | str, lower: bool = True) -> Column:
    return all_matches(F.lower(_c(text)) if lower else text, HASHTAG, 1)


def mentions(text: Column | str, lower: bool = True) -> Column:
    """Lower-cased without @, or as written with it."""
    return all_matches(F.lower(_c(text)), MENTION, 1) if lower else all_matches(text, MENTION, 0)


def domains(text: Column | str) -> Column:
    """Network locations (port and user part included) of all URLs."""
    found = F.transform(urls(text), lambda u: F.regexp_extract(u, r"^https?://([^/?#]*)", 1))
    return F.filter(found, lambda d: d != "")


def tokens(text: Column | str) -> Column:
    return all_matches(F.lower(_c(text)), WORD)


def long_tokens(text: Column | str, longer_than: int = 3) -> Column:
    """Tokens longer than longer_than."""
    return all_matches(F.lower(_c(text)), WORD.removesuffix("+") + f"{{{longer_than + 1},}}")


def keywords(text: Column | str, stop: list[str] = STOP_KEYWORDS, longer_than: int = 3) -> Column:
    """Tokens longer than longer_than that are no stop words."""
    kept = [w for w in stop if len(w) > longer_than]
    return F.filter(long_tokens(text, longer_than), lambda w: ~w.isin(kept))


def keyword_rows(df: DataFrame, columns: list[Column], text: Column | str, stop: list[str] = STOP_KEYWORDS, longer_than: int = 3) -> DataFrame:
    """A row for each keyword, with its place `pos` among the long tokens: keywords() without an array of what is kept."""
    rows = df.select(*columns, F.posexplode(long_tokens(text, longer_than)).alias("pos", "word"))
    return rows.filter(~F.col("word").isin([w for w in stop if len(w) > longer_than]))


def any_of(words: list[str]) -> str:
    """A pattern of these words (plain letters) as a tree of their beginnings, so that few places are tried twice."""

    def branch(rest: list[str]) -> str:
        heads = sorted({w[0] for w in rest if w})
        parts = [h + branch([w[1:] for w in rest if w[:1] == h]) for h in heads]
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
        return f"(?:{body})?" if "" in rest and body else body

    return branch(list(dict.fromkeys(words)))


def words(text: Column | str) -> Column:
    """Split at white space, lower-cased."""
    return F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != "")


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), SPACES, " "))


def squash(text: Column | str, keep: int = 3) -> Column:
    """Runs of one character longer than keep become keep characters."""
    return F.regexp_replace(_c(text), rf"(?d)(.)\1{{{keep},}}", "$1" * keep)


def normalise(text: Column | str) -> Column:
    """The form that duplicates share: no URLs, no mentions, single spaces, lower case."""
    out = _c(text)
    out = F.when(F.contains(out, F.lit("http")), F.regexp_replace(out, r"https?://\S+", "")).otherwise(out)
    out = F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, r"@[\p{L}\p{N}_]+", "")).otherwise(out)
    return F.trim(F.lower(F.regexp_replace(out, SPACES, " ")))


def text_hash(text: Column | str) -> Column:
    return F.md5(normalise(text).cast("binary"))


def only_alphanumeric(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"[^a-zA-Z0-9\s]", "")


def without_numbers(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\p{Nd}+", "")


def has_emoji(text: Column | str, compat: bool = False) -> Column:
    return _c(text).rlike(EMOJI_COMPAT if compat else EMOJI_STRICT)


def emoji_tokens(text: Column | str, compat: bool = False) -> Column:
    """Known emoji become ' [NAME] ', others go."""
    out = _c(text)
    for emoji, name in EMOJI_TOKENS.items():
        out = F.replace(out, F.lit(emoji), F.lit(f" [{name}] "))
    return F.regexp_replace(out, f"{EMOJI_COMPAT if compat else EMOJI_STRICT}+", "")


def clip(text: Column | str, size: int, mark: str = "...", at: int | None = None) -> Column:
    """At most size characters as they are; longer texts cut at `at` (size) and marked."""
    text = _c(text)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, at or size), F.lit(mark))).otherwise(text)


def number(text: Column | str) -> Column:
    """A number out of a string with currency signs, commas and spaces; null if none."""
    return F.regexp_replace(_c(text), r"[₹$€£¥,\s]", "").try_cast("double")


def chunks(text: Column | str, size: int = 6000) -> Column:
    """Pieces of fixed width in order."""
    text = F.coalesce(_c(text), F.lit(""))
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def strip_fences(text: Column | str) -> Column:
    """A JSON answer without its Markdown fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(text)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
