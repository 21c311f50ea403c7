"""Analyzers: text to terms with positions.

Every built-in analyzer is two things that agree: a Column expression that
stays in the JVM (``tokens``), and plain Python for query strings
(``tokenize``). A user's analyzer is a Python function behind an Arrow UDF.

A position is the number of a token in its field, from 0. Stop words leave a
gap. Tokens over the length limit are cut into pieces that take a position each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import IllegalArgument

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a Python worker, and tokens that are Python objects at once there.
BATCH_SIZE, PACKED = 8 << 20, 50_000
TOKENS = "array<struct<term:string,pos:int>>"
MAX_TOKEN = 255

# The usual English stop words.
ENGLISH = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

# Word segmentation by Unicode properties. Scripts without spaces give a token a character.
_SOLO = r"\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[\p{{IsAlphabetic}}&&[^{_SOLO}\p{{IsKatakana}}]]\p{{Nd}}\p{{Pc}}\p{{M}}\p{{Cf}}"
_LETTER = rf"[\p{{IsAlphabetic}}&&[^{_SOLO}\p{{IsKatakana}}\p{{M}}\p{{Nd}}]]"
_MID_LETTER = r"['.\u2018\u2019\u2024\u00b7\u0387\u05f4\u2027\ufe13\ufe52\ufe55\uff07\uff0e\uff1a:]"
_MID_NUMBER = r"['.,;\u2018\u2019\u2024\u037e\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe52\ufe54\uff07\uff0c\uff0e\uff1b]"
_EXTEND = r"[\p{M}\p{Cf}]"
_HEBREW = r"[\p{IsHebrew}&&\p{L}]"
#: Java syntax; every group is possessive, since java.util.regex would recurse on others.
#: ASCII is told by ranges that come first, and guards spare it the other classes; they change no match.
UNICODE_WORD = (
    r"(?![\x00-/:-@\[-^`{-\x7f])(?:"
    rf"(?=[a-z0-9]|\p{{Pc}}*+[[\p{{IsAlphabetic}}&&[^{_SOLO}]]\p{{Nd}}])"
    rf"(?:[a-z0-9{_WORD}]++(?:(?![\x00-!#-&(-+\-/<-\x7f])(?:(?<={_LETTER}{_EXTEND}{{0,8}}){_MID_LETTER}{_EXTEND}*+(?={_LETTER})"
    rf"|(?<=\p{{Nd}}{_EXTEND}{{0,8}}){_MID_NUMBER}{_EXTEND}*+(?=\p{{Nd}})"
    rf"|(?<={_HEBREW}{_EXTEND}{{0,8}})\"{_EXTEND}*+(?={_HEBREW}))[a-z0-9{_WORD}]++)*+"
    rf"(?:(?=')(?<={_HEBREW}{_EXTEND}{{0,8}})'{_EXTEND}*+)?+"
    rf"|[\p{{IsKatakana}}\u30fc\p{{Pc}}\p{{M}}\p{{Cf}}]++)"
    rf"|[{_SOLO}]{_EXTEND}*+|[\p{{No}}\p{{Nl}}])"
)
#: White space that separates tokens: Unicode's without the no-break spaces, with U+001C to U+001F and U+0085.
SPACE = r"[\t-\r\x1c-\x1f \x85\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]"
ALPHABETIC = r"[a-z\p{IsAlphabetic}]++"


def small_batches() -> None:
    """Texts and their tokens go to Python workers some megabytes at a time; a bound that the user has set stays."""
    spark = SparkSession.active()
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(BATCH_SIZE))


def _python(pattern: str) -> regex.Pattern:
    """A Java pattern for the regex module."""
    p = regex.sub(r"\\u([0-9a-f]{4})", lambda m: regex.escape(chr(int(m[1], 16)), literal_spaces=True), pattern)
    p = p.replace("&&[^", "--[").replace(r"\p{IsAlphabetic}", r"\p{Alphabetic}")
    p = regex.sub(r"\\p\{Is(Han|Hiragana|Thai|Lao|Khmer|Myanmar|Katakana|Hebrew)\}", r"\\p{Script=\1}", p)
    return regex.compile(p, regex.V1)


def lower(text: Column) -> Column:
    """Lower case a code point at a time: no dotted capital I in two parts, no final sigma."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def lower_text(text: str) -> str:
    return text.replace("İ", "i").replace("Σ", "σ").lower()


class Analyzer:
    """Text to tokens; subclasses give ``words`` as a Column and ``split`` in Python."""

    #: Whether the Column form is a Python UDF.
    python = False

    def __init__(self, stop_words: Iterable[str] = (), max_token_length: int | None = MAX_TOKEN):
        if max_token_length is not None and max_token_length < 1:
            raise IllegalArgument("max_token_length must be at least 1")
        self.stop_words = tuple(sorted(set(stop_words)))
        self.max_token_length = max_token_length

    def words(self, text: Column) -> Column:
        raise NotImplementedError

    def split(self, text: str) -> Iterator[str]:
        raise NotImplementedError

    def pieces(self, text: Column) -> Column:
        """The words as an array of strings, long ones cut; an index is a position. Null texts have none."""
        words = F.coalesce(self.words(text), F.array().cast("array<string>"))
        n = self.max_token_length
        if n is None:
            return words
        cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= n, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s).{{1,{n}}}"), F.lit(0)))))
        # No word holds ASCII white space, so most texts show at once that they have no long one.
        return F.when(text.rlike(rf"\A(?:[^ \t-\r]{{0,{n}}}+[ \t-\r]++)*+[^ \t-\r]{{{n + 1}}}"), cut).otherwise(words)

    def tokens(self, text: Column) -> Column:
        """An array of (term, pos); null texts have none."""
        out = F.transform(self.pieces(text), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
        if self.stop_words:
            stop = F.array(*map(F.lit, self.stop_words))
            out = F.filter(out, lambda t: ~F.array_contains(stop, t.term))
        return out

    def tokenize(self, text: str) -> list[tuple[str, int]]:
        """The same in Python."""
        n, stop = self.max_token_length, frozenset(self.stop_words)
        words = (w[a : a + n] for w in self.split(text) for a in range(0, len(w), n)) if n else self.split(text)
        return [(w, i) for i, w in enumerate(words) if w not in stop]

    def for_field(self, name: str) -> Analyzer:
        return self


class PatternAnalyzer(Analyzer):
    """The matches of a pattern, in lower case unless told otherwise."""

    def __init__(self, pattern: str, lowercase: bool = True, **options):
        super().__init__(**options)
        self.pattern, self.lowercase = pattern, lowercase
        self._compiled = _python(pattern)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(lower(text) if self.lowercase else text, F.lit(self.pattern), F.lit(0))

    def split(self, text: str) -> Iterator[str]:
        return (m[0] for m in self._compiled.finditer(lower_text(text) if self.lowercase else text))


class StandardAnalyzer(PatternAnalyzer):
    """Unicode words that hold a letter or a digit, in lower case."""

    def __init__(self, stop_words: Iterable[str] = (), max_token_length: int = MAX_TOKEN):
        super().__init__(UNICODE_WORD, stop_words=stop_words, max_token_length=max_token_length)

    @classmethod
    def english(cls) -> StandardAnalyzer:
        return cls(ENGLISH)

    def with_stop_words(self, words: Iterable[str]) -> StandardAnalyzer:
        return StandardAnalyzer(words, self.max_token_length)

    def with_max_token_length(self, n: int) -> StandardAnalyzer:
        return StandardAnalyzer(self.stop_words, n)


class SimpleAnalyzer(PatternAnalyzer):
    """Runs of letters, in lower case."""

    def __init__(self, **options):
        super().__init__(ALPHABETIC, **options)


class WhitespaceAnalyzer(PatternAnalyzer):
    """What stands between white space, as it is."""

    def __init__(self, **options):
        # ASCII is told by ranges first, which change no match.
        super().__init__(rf"(?:[!-~]++|(?![\t-\r\x1c- ])[^{SPACE[1:-1]}]++)++", lowercase=False, **options)


class KeywordAnalyzer(Analyzer):
    """The whole value as one token; an empty one gives none."""

    def __init__(self):
        super().__init__(max_token_length=None)

    def words(self, text: Column) -> Column:
        return F.when(text != "", F.array(text))

    def split(self, text: str) -> Iterator[str]:
        return iter([text] if text else [])


class FunctionAnalyzer(Analyzer):
    """A user's Python function from a text to (term, position increment) pairs."""

    python = True

    def __init__(self, function: Callable[[str], Iterable[tuple[str, int]]]):
        super().__init__(max_token_length=None)
        self.function = function

    def tokenize(self, text: str) -> list[tuple[str, int]]:
        out, at = [], -1
        for term, step in self.function(text):
            if step < 0 or not out and step < 1:
                raise IllegalArgument("position increments are 0 or more, the first 1 or more")
            at += step
            out.append((term, at))
        return out

    def tokens(self, text: Column) -> Column:
        return self.tokens_of(F.array(text))

    def tokens_of(self, values: Column) -> Column:
        """The tokens of an array of texts, whose positions go on from value to value."""
        tokenize = self.tokenize
        kind = pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())]))

        small_batches()

        @F.arrow_udf(TOKENS)
        def run(batch: pa.Array) -> pa.Array:
            # Tokens are Python objects for a few texts at a time, then flat arrays.
            parts, terms, places, ends = [], [], [], []

            def pack() -> None:
                parts.append(pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(places, pa.int32())], names=["term", "pos"]))
                terms.clear()
                places.clear()

            for texts in batch:
                base, n = 0, ends[-1] if ends else 0
                for t in texts.as_py() or []:
                    own = tokenize(t or "")
                    terms.extend(w for w, _ in own)
                    places.extend(p + base for _, p in own)
                    base += own[-1][1] + 1 if own else 0
                    n += len(own)
                    if len(terms) >= PACKED:
                        pack()
                ends.append(n)
            pack()
            return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.concat_arrays(parts)).cast(kind)

        return run(values)


class PerFieldAnalyzer(Analyzer):
    """An analyzer for each field, and one for all others."""

    def __init__(self, default: Analyzer, fields: dict[str, Analyzer] | None = None):
        super().__init__()
        self.default, self.fields = default, dict(fields or {})

    def with_field(self, name: str, analyzer: Analyzer) -> PerFieldAnalyzer:
        return PerFieldAnalyzer(self.default, {**self.fields, name: analyzer})

    def for_field(self, name: str) -> Analyzer:
        return self.fields.get(name, self.default).for_field(name)

    def tokens(self, text: Column) -> Column:
        return self.default.tokens(text)

    def tokenize(self, text: str) -> list[tuple[str, int]]:
        return self.default.tokenize(text)


def tokenize(analyzer: Analyzer, field: str, text: str) -> list[tuple[str, int]]:
    """(term, position) pairs of a text in a field."""
    return analyzer.for_field(field).tokenize(text)


def field_tokens(analyzer: Analyzer, values: Column, multi: bool) -> Column:
    """The tokens of a field: of a string, or of an array of strings whose positions go on from value to value.

    What a stop word at the end of a value would have added is lost.
    """
    if not multi:
        return analyzer.tokens(values)
    if isinstance(analyzer, FunctionAnalyzer):
        return analyzer.tokens_of(values)
    each = F.transform(F.filter(values, lambda v: v.isNotNull()), analyzer.tokens)
    none = F.array().cast(TOKENS)
    start = F.struct(none.alias("all"), F.lit(0).alias("next"))

    def step(acc: Column, own: Column) -> Column:
        moved = F.transform(own, lambda t: F.struct(t.term.alias("term"), (t.pos + acc.next).alias("pos")))
        end = F.when(F.size(own) > 0, F.element_at(own, -1).pos + 1 + acc.next).otherwise(acc.next)
        return F.struct(F.concat(acc.all, moved).alias("all"), end.alias("next"))

    return F.coalesce(F.aggregate(each, start, step, lambda a: a.all), none)
