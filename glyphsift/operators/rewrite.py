"""Text normalisation and rewriting, as Column expressions."""

from __future__ import annotations

import json
from importlib.resources import files
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsift.functions import unicode_tables as U
from glyphsift.functions.text import ascii_only, let, strip, whitespace_tokens
from glyphsift.operators import carriers

# Typographic substitutions, contractions, function words, script buckets, words of C that keep their names, the sentence pattern.
SUBSTITUTIONS = [("—", " - "), ("–", "-"), ("[‘’]", "'"), ("[“”]", '"'), ("…", "..."), ("[ \\t]{2,}", " ")]
CONTRACTIONS = [("do not", "don't"), ("does not", "doesn't"), ("is not", "isn't"), ("it is", "it's"), ("cannot", "can't"), ("will not", "won't")]
FUNCTION_WORDS = {
    "en": ["the", "and", "of", "to", "a", "in", "is", "that", "for", "it", "on", "with"],
    "es": ["el", "la", "de", "que", "y", "en", "los", "las", "un", "una", "por", "con"],
    "fr": ["le", "la", "de", "et", "les", "des", "un", "une", "que", "est", "dans", "pour"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "ist", "mit", "ein", "auf"],
}
BUCKETS = [("han", "\\x{4E00}-\\x{9FFF}"), ("kana", "\\x{3040}-\\x{30FF}"), ("hangul", "\\x{AC00}-\\x{D7AF}"), ("arabic", "\\x{600}-\\x{6FF}"), ("hebrew", "\\x{590}-\\x{5FF}"), ("cyrillic", "\\x{400}-\\x{4FF}"), ("devanagari", "\\x{900}-\\x{97F}"), ("latin", "A-Za-z")]
BUCKET_LANGUAGE = {"hangul": "ko", "arabic": "ar", "hebrew": "he", "cyrillic": "ru", "devanagari": "hi"}
C_KEEP = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed "
    "sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary size_t ssize_t ptrdiff_t wchar_t bool true false "
    "int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t intptr_t uintptr_t FILE NULL STR CHR"
).split()
SENTENCE = "(?s).*?[.!?]+(?:[\"')\\]]+)?(?:\\s+|\\z)|(?s).+\\z"


def load_lexicon(path: str | None = None) -> dict[str, list[str]]:
    """Pivot -> words of one sense, from JSON ``{"groups": [{"pivot": ..., "words": [...]}]}``; the last word is what comes back.

    Without a path the engine's own table.  Of two groups with one pivot, or of a
    word in two groups, the later counts.
    """
    raw = Path(path).read_text(encoding="utf-8") if path else (files("glyphsift") / "data" / "lexicon.json").read_text(encoding="utf-8")
    return {g["pivot"]: list(g["words"]) for g in json.loads(raw)["groups"]}


LEXICON = load_lexicon()


def english_vocabulary(lexicon: dict[str, list[str]] = LEXICON) -> list[str]:
    """Every word of the lexicon, sorted."""
    return sorted({w for words in lexicon.values() for w in words})


def content_vocabulary(lexicon: dict[str, list[str]] = LEXICON) -> list[str]:
    """Words that share a pivot with another one, sorted: a round trip can change them."""
    return sorted({w for words in lexicon.values() if len(words) > 1 for w in words})


def normalize_carriers(text: Column) -> Column:
    """Comments out, hidden characters out unless their context clears them, dense odd spaces to spaces, look-alikes folded.

    All neighbour rules see the characters as they stood, so the order of the
    removals doesn't matter.
    """
    clears, vs = U.EMOJI + U.shaping(), U.SELECTORS
    always = [f"[{U.TAGS}]", f"[{U.plain_format()}]", "(?s)(?<=.)\\x{FEFF}", f"[{U.JOINERS}](?<![{clears}].)(?![{clears}])", f"[{vs}]{{2,}}", f"[{U.of(0xFE0E, 0xFE0F)}](?<![{vs}{U.EMOJI}].)(?![{vs}])", f"[{U.of((0xFE00, 0xFE0D))}](?<![{vs}].)(?![{vs}])", f"(?<![{vs}{U.script('CJK')}])[{U.of((0xE0100, 0xE01EF))}](?![{vs}])"]
    # one cheap look at each character before any of the classes
    found = lambda ps: f"(?s)(?=[{carriers.SOFT}{carriers.HIGH}])(?:({carriers.FLAG})|{'|'.join(ps)})"
    exotic = f"[{U.of(0xA0, 0xAD, (0x131, 0x131), (0x370, 0x10FFFF))}]"

    def stripped(bare: Column) -> Column:
        out = F.when(carriers.has_rtl(bare), F.regexp_replace(bare, found(always), "$1")).otherwise(F.regexp_replace(bare, found([*always, f"[{U.MARKS}]"]), "$1"))
        spaced = lambda t: F.when(bare.rlike(f"[{U.SPACES}]"), F.when(carriers.dense_spaces(bare), F.regexp_replace(t, f"[{U.SPACES}]", " ")).otherwise(t)).otherwise(t)
        return F.when(ascii_only(bare) | ~bare.rlike(exotic), bare).otherwise(let(let(out, spaced), fold_homoglyphs))

    # each step is bound, as the next one looks at it several times
    return let(F.when(F.contains(text, F.lit("<!--")), F.regexp_replace(text, carriers.COMMENT, "")).otherwise(text), stripped)


def fold_homoglyphs(text: Column) -> Column:
    """Look-alikes to Latin letters within words of more than one script."""
    keys, values = "".join(map(chr, U.CONFUSABLES)), "".join(U.CONFUSABLES.values())
    word = lambda w: F.when(~ascii_only(w) & (F.size(carriers.scripts_of(w)) >= 2), F.translate(w, keys, values)).otherwise(w)
    inner = lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit(f"([{U.quick(U.word_chars())}]+|[{U.quick(U.others(U.word_chars()))}]+)"), F.lit(1)), word), "")
    runs = F.regexp_extract_all(text, F.lit(f"({carriers.RUN}+|[^{carriers.RUN[1:]}+)"), F.lit(1))
    folded = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"[{keys}]"), inner(r)).otherwise(r)), "")
    return F.when(text.rlike(f"[{keys}]"), folded).otherwise(text)


def token_edits(text: Column) -> Column:
    for pattern, to in SUBSTITUTIONS:
        text = F.regexp_replace(text, pattern, to)
    for a, b in CONTRACTIONS:
        # the plain words first: the long classes are looked at only where they stand
        text = F.regexp_replace(text, f"{a}(?<![{U.word_chars()}]{a})(?![{U.word_chars()}])", b)
    return text


def split_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def reorder_reverse(text: Column) -> Column:
    """Sentences in reverse order; twice is the same as none, but for white space."""
    return F.array_join(F.reverse(split_sentences(text)), " ")


def reverse_words(text: Column) -> Column:
    """Letters of each ASCII word reversed; an involution."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), lambda t: F.when(t.rlike("^[A-Za-z]"), F.reverse(t)).otherwise(t)), "")


def _maps(lexicon: dict[str, list[str]]) -> tuple[Column, Column]:
    there = {w: pivot for pivot, en in lexicon.items() for w in en}
    out = [F.lit(x) for pair in there.items() for x in pair]
    back = [F.lit(x) for pivot, en in lexicon.items() for x in (pivot, en[-1])]
    return F.create_map(*out), F.create_map(*back)


def _known(word: Column, lexicon: dict[str, list[str]]) -> Column:
    """Whether the lexicon has the word: a look into a set, where a map is searched from its first entry."""
    return F.lower(word).isin(english_vocabulary(lexicon))


def _cased(model: Column, word: Column) -> Column:
    upper = (F.upper(model) == model) & (F.lower(model) != model)
    first = F.substring(model, 1, 1)
    title = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(upper, F.upper(word)).when(title, F.concat(F.upper(F.substring(word, 1, 1)), word.substr(F.lit(2), F.length(word)))).otherwise(word)


def roundtrip_translate(text: Column, lexicon: dict[str, list[str]] = LEXICON) -> Column:
    """There and back through the pivot lexicon, keeping case."""
    there, back = _maps(lexicon)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), lambda t: F.when(_known(t, lexicon), F.coalesce(_cased(t, F.try_element_at(back, F.try_element_at(there, F.lower(t)))), t)).otherwise(t)), "")


def roundtrip_tokens(tokens: Column, lexicon: dict[str, list[str]] = LEXICON) -> Column:
    there, back = _maps(lexicon)
    return F.transform(tokens, lambda t: F.when(_known(t, lexicon), F.coalesce(F.try_element_at(back, F.try_element_at(there, F.lower(t))), F.lower(t))).otherwise(F.lower(t)))


def detect_language(text: Column) -> Column:
    """Language by script majority (first in the text on ties), then by function words.

    A text without a character at U+0370 or above has one script at most, which
    one look tells; places are looked up for ties alone, and function words only
    for Latin texts.
    """

    def majority(t: Column) -> Column:
        """The script's name, ``ja`` apart: kana, or han beside kana."""
        counts = lambda: F.array(*[F.struct(F.regexp_count(t, F.lit(f"[{cls}]")).alias("n"), F.lit(name).alias("name"), F.lit(cls).alias("cls")) for name, cls in BUCKETS])
        first = lambda x: F.length(F.call_function("regexp_extract", t, F.concat(F.lit("(?s)^[^"), x["cls"], F.lit("]*")), F.lit(0)))

        def winner(ns: Column) -> Column:
            most = F.array_max(F.transform(ns, lambda x: x["n"]))
            tied = lambda m: F.filter(ns, lambda x: x["n"] == m)
            name = lambda m: let(tied(m), lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0))["name"]).otherwise(F.array_min(F.transform(xs, lambda x: F.struct(first(x).alias("p"), x["name"].alias("name"))))["name"]))
            kana = F.exists(ns, lambda x: (x["name"] == "kana") & (x["n"] > 0))
            return let(most, lambda m: F.when(m > 0, let(name(m), lambda n: F.when((n == "kana") | ((n == "han") & kana), "ja").otherwise(n))))

        return F.when(~t.rlike(f"[{carriers.HIGH}]"), F.when(t.rlike("[A-Za-z]"), "latin")).otherwise(let(counts(), winner))

    def votes(t: Column) -> Column:
        every = sorted({w for fn in FUNCTION_WORDS.values() for w in fn})
        met = F.array_intersect(F.split(F.lower(t), f"[{U.PY_SPACE}]+"), F.array(*map(F.lit, every)))
        count = lambda ws: F.array_max(F.array(*[F.struct(F.size(F.array_intersect(ws, F.array(*map(F.lit, fn)))).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, fn) in enumerate(FUNCTION_WORDS.items())]))
        return let(let(met, count), lambda best: F.when(best["n"] > 0, best["lang"]).otherwise("en"))

    def named(top: Column) -> Column:
        out = F.when(top.isNull(), "und").when(top == "han", "zh").when(top == "ja", "ja")
        for bucket, lang in BUCKET_LANGUAGE.items():
            out = out.when(top == bucket, lang)
        return out.otherwise(votes(text))

    return let(majority(text), named)


def canonicalize_c(code: Column) -> Column:
    """Comments and literals out, identifiers renamed in the order of first use."""
    w, s = U.word_chars(), U.PY_SPACE
    for pattern, to in ((r"(?s)/\*.*?\*/|//[^\n]*", " "), (r'(?s)"(?:\\.|[^"\\])*"', " STR "), (r"'(?:\\.|[^'\\])*'", " CHR ")):
        code = F.regexp_replace(code, pattern, to)
    tokens = F.regexp_extract_all(code, F.lit(f"([A-Za-z_][{U.quick(w)}]*|[0-9]+\\.?[0-9]*|[{U.quick(U.others(w + s))}])"), F.lit(1))
    name = lambda t: t.rlike("^[A-Za-z_]") & ~t.isin(C_KEEP)
    renamed = lambda ts, names: F.transform(ts, lambda t: F.when(name(t), F.concat(F.lit("v"), (F.array_position(names, t) - 1).cast("string"))).otherwise(t))
    return F.array_join(let(tokens, lambda ts: let(F.array_distinct(F.filter(ts, name)), lambda names: renamed(ts, names))), " ")
