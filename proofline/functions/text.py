"""Text scalars: Column in, Column out, no user functions. A null text gives null unless the docstring says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions import lexicons as L

# A narration word is ASCII alphanumeric with at most one inner apostrophe, straight or curled; a sentence
# ends behind its mark or with its line.
NARRATION_WORD = r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?"
SENTENCE_END = r"(?<=[.!?])\s+|\n+"


def normalise_text(text: Column) -> Column:
    """One kind of newline, single blanks, trimmed lines, at most one empty line in a row."""
    for pattern, by in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def strip(text: Column) -> Column:
    """Without blanks and newlines at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unwrap_paragraphs(text: Column) -> Column:
    """Lines of a paragraph joined by a blank; paragraphs stay apart by one empty line."""
    paragraphs = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\s*\n"), lambda p: strip(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def pieces(text: Column, least: int = 0) -> Column:
    """The parts of a text between sentence ends that are longer than least characters, in order; wrapped lines are parts."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def sentences(text: Column, least: int = 12) -> Column:
    """Sentences longer than least characters, in order; lines that a paragraph wraps over are joined first."""
    return F.filter(F.transform(F.split(unwrap_paragraphs(text), SENTENCE_END), strip), lambda s: F.length(s) > least)


def word_count(text: Column) -> Column:
    """How many runs without blanks a text has."""
    return F.regexp_count(text, F.lit(r"\S+"))


def narration_word_count(text: Column) -> Column:
    """How many narration words a text has."""
    return F.regexp_count(text, F.lit(NARRATION_WORD))


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def folded(text: Column) -> Column:
    """Text for comparison without case: ß and ss, ς and σ, K and k are the same, and dotless i stays as it is."""
    upper = F.translate(F.upper(F.translate(text, "ı", "\ue000")), "\ue000", "ı")  # Spark would take lower(upper(x)) for lower(x)
    return F.translate(F.lower(upper), "ς", "σ")


def lexical_words(text: Column) -> Column:
    """Runs of letters and digits, folded; an underscore ends a word."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spoken_seconds(words: Column, per_second: Column, least: float = 0.6) -> Column:
    """Seconds to speak so many words; none take none, any take least or longer."""
    return F.when(words == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(least), words / per_second), 2))


def display_text(text: Column) -> Column:
    """Letters, digits and single blanks in upper case."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""), r"\s+", " ")))


def wrap_lines(text: Column, width: int) -> Column:
    """Greedy lines of at most width characters; a longer word has a line of its own."""
    start = F.expr("named_struct('lines', cast(array() as array<string>), 'line', '')")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def put(a: Column, w: Column) -> Column:
        fits = F.length(a["line"]) + 1 + F.length(w) <= width
        first = a["line"] == ""
        lines = F.when(first | fits, a["lines"]).otherwise(F.array_append(a["lines"], a["line"]))
        return F.struct(lines.alias("lines"), F.when(first, w).when(fits, F.concat(a["line"], F.lit(" "), w)).otherwise(w).alias("line"))

    return F.aggregate(words, start, put, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.array_append(a["lines"], a["line"])))


def cue_score(text: Column, cues: list[str]) -> Column:
    """How many of the cue phrases a text contains, whatever the case."""
    low = F.lower(text)
    return reduce(lambda a, c: a + F.contains(low, F.lit(c.lower())).cast("int"), cues, F.lit(0))


def first_kind(text: Column, kinds: list[tuple[str, list[str]]], default: str) -> Column:
    """The first kind of which a cue occurs."""
    out = F.lit(default)
    for kind, cues in reversed(kinds):
        out = F.when(cue_score(text, cues) > 0, kind).otherwise(out)
    return out


def tags(text: Column, lexicons: dict[str, list[str]], implied: dict[str, str] | None = None) -> Column:
    """Sorted tags whose words meet the text's; implied adds a tag to the tag that brings it."""
    own = tokens(text)
    found = F.array_compact(F.array(*[F.when(F.arrays_overlap(own, F.array(*map(F.lit, words))), F.lit(t)) for t, words in lexicons.items()]))
    for tag, more in (implied or {}).items():
        found = F.when(F.array_contains(found, tag), F.array_append(found, F.lit(more))).otherwise(found)
    return F.array_sort(F.array_distinct(found))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text has."""
    return F.size(F.array_intersect(F.array_distinct(tokens(text)), F.array(*map(F.lit, words))))


def classify_event(text: Column) -> Column:
    """twist, conflict or cliffhanger, whose cue a sentence has first in this order, else event."""
    return first_kind(text, [("twist", L.TWIST_CUES), ("conflict", L.CONFLICT_CUES), ("cliffhanger", L.CLIFF_CUES)], "event")


def _plain_words(text: Column) -> Column:
    """The distinct runs of a-z of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))


def narration_tags(text: Column) -> Column:
    """Sorted tags whose words a narration has; some words of action are an attack too."""
    own = _plain_words(text)
    listed = {**L.TAG_WORDS, "attack": L.ATTACK_WORDS}
    return F.array_sort(F.array_compact(F.array(*[F.when(F.arrays_overlap(own, F.array(*map(F.lit, words))), F.lit(tag)) for tag, words in listed.items()])))


def narration_language(text: Column) -> Column:
    """en if a narration has more of the English words than of the Indonesian ones, else id."""
    own = _plain_words(text)
    many = lambda words: F.size(F.array_intersect(own, F.array(*map(F.lit, words))))
    return F.when(many(L.ENGLISH) > many(L.INDONESIAN), "en").otherwise("id")


def without_reveals(text: Column, level: Column, minimal: str = "minimal") -> Column:
    """At the minimal level the sentences that give no outcome away, and a tease if none stays; the text itself at others."""
    kept = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(f"(?iU){L.REVEAL}"))
    cleaned = strip(F.array_join(kept, " "))
    return F.when(level != minimal, text).when(cleaned == "", L.TEASE).otherwise(cleaned)


def has_call(text: Column) -> Column:
    """Whether a passage calls to the viewer, by any of the patterns."""
    return folded(text).rlike("|".join(L.CALLS))


def shorten(text: Column, n: int) -> Column:
    """The first n words and three dots; the text itself if it has no more."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.when(F.size(words) <= n, strip(text)).otherwise(F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, n), " "), "[,;:.]+$", ""), F.lit("...")))


#: Letters whose capital is one letter, where a string's upper case takes two (sharp s, Greek letters with an iota).
_SMALL = "ß" + "".join(chr(base + i) for base in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)) + "ᾳῃῳ"
_LARGE = "ẞ" + "".join(chr(base + i) for base in (0x1F88, 0x1F98, 0x1FA8) for i in range(8)) + "ᾼῌῼ"


def capital(letter: Column) -> Column:
    """One letter as one capital; a letter without a single one stays as it is."""
    upper = F.upper(letter)
    return F.when(F.length(upper) <= 1, upper).otherwise(F.translate(letter, _SMALL, _LARGE))


def compress_clause(sentence: Column, openers: list[str], tails: list[str], fillers: list[str], keeps: tuple[list[str], list[str]], n: int) -> Column:
    """A sentence without opener and subordinate tail, as at most n words.

    keeps has the marker words of a language whose function words stay, and those of one whose do not: with more of the
    first a text is only shortened and ends with a full stop. Else punctuation and fillers go, but for a filler at the
    front, and the first letter is large; if nothing is left, the whole sentence is shortened. Empty: empty.
    """
    text = F.regexp_replace(strip(sentence), rf"(?i)^(?:{'|'.join(openers)})(?:[,\s]+|([^\p{{L}}\p{{N}}_])|$)", "$1")
    text = F.regexp_replace(text, rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(tails)})(?:[^\p{{L}}\p{{N}}_].*)?$", "$1")
    text = F.regexp_replace(text, "[ .,;:]+$", "")
    known = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    yes, no = (F.size(F.array_intersect(known, F.array(*map(F.lit, words)))) for words in keeps)
    whole = F.when(text == "", "").otherwise(F.concat(F.regexp_replace(shorten(text, n), r"\.+$", ""), F.lit(".")))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_'-]+|[.,!?]"), F.lit(0))
    kept = F.slice(F.filter(words, lambda w, i: ~w.isin(".", ",", "!", "?") & ((i == 0) | ~F.lower(w).isin(*fillers))), 1, n)
    line = F.array_join(kept, " ")
    terse = F.when(F.size(kept) == 0, shorten(sentence, n)).otherwise(F.concat(capital(F.substring(line, 1, 1)), F.substr(line, F.lit(2))))
    return F.when(strip(sentence) == "", "").when(yes > no, whole).otherwise(terse)


def drop_reveals(text: Column, pattern: str, tease: str) -> Column:
    """The sentences that do not match pattern; tease if none stays."""
    kept = F.filter(pieces(text), lambda s: ~s.rlike(pattern))
    return F.when(F.size(kept) == 0, F.lit(tease)).otherwise(F.array_join(kept, " "))


def replace_terms(text: Column, mapping: list[tuple[str, str]]) -> Column:
    """Whole-word replacements in the order of mapping, whatever the case."""
    for old, new in mapping:
        text = F.regexp_replace(text, rf"(?i)\b{old}\b", new)
    return text


def source_family(path: Column) -> Column:
    """Path without the extension and the page number of its last part; "unknown" for null or empty.

    A number counts with a separator before it: "_12", "-12" or "_p12"; in a name with a double underscore only "_p12"
    does. What would leave nothing stays.
    """
    parts = F.filter(F.split(F.btrim(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    stem = F.regexp_replace(last, r"^(.+)\.[^.]+$", "$1")
    number = F.when(F.contains(stem, F.lit("__")), F.regexp_replace(stem, r"(?i)[_-]p[0-9]+$", "")).otherwise(F.regexp_replace(stem, r"(?i)[_-]p?[0-9]+$", ""))
    family = F.coalesce(F.nullif(F.regexp_replace(number, "[_-]+$", ""), F.lit("")), F.nullif(stem, F.lit("")), F.lit("unknown"))
    return F.array_join(F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(family)), "/")


def redact(text: Column, patterns: list[str], length: int = 300) -> Column:
    """One line of at most length characters with what matches a pattern blanked out."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "[redacted]")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length)


def mask_tail(value: Column, keep: int = 4) -> Column:
    """Stars, and the last keep characters if there are more; <unset> for null or empty."""
    masked = F.when(F.length(value) <= keep, F.repeat(F.lit("*"), F.length(value))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(value) - keep), F.right(value, F.lit(keep))))
    return F.when(F.coalesce(value, F.lit("")) == "", "<unset>").otherwise(masked)


def normalise_url(url: Column, longest: int = 200) -> Column:
    """An http(s) address without query, fragment and closing slash; null if it is none or too long."""
    bare = F.rtrim(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/"))
    return F.when(url.rlike(r"^https?://[^/?#]+") & (F.length(url) <= longest), bare)


def strip_code_fence(text: Column) -> Column:
    """Without the code fence that a text begins and ends with."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word runs of an array of words, as text; none if it has fewer words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))
