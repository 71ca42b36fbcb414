"""Prompts for models of the user's own, and what their answers say.  No model is called here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsift.functions.text import USEFUL_WORDS, let, strip, whitespace_tokens
from glyphsift.operators.keyless import draw

LENGTH = f"The answer has to have more than {USEFUL_WORDS} words."


def choice_prompt(context: Column, a: Column, b: Column, *seed: Column) -> Column:
    """``struct<prompt, first_is_a>``: asks for one of two words, in an order by hash of ``seed``, so that a liking for a place evens out."""

    def asked(first_is_a: Column) -> Column:
        options = F.when(first_is_a, F.concat(a, F.lit(" or "), b)).otherwise(F.concat(b, F.lit(" or "), a))
        text = F.concat(F.lit("CONTEXT: "), context, F.lit("\nTASK: choose one of "), options, F.lit("; both are fine. End with a line ANSWER: <choice>"))
        return F.struct(text.alias("prompt"), first_is_a.alias("first_is_a"))

    return let(F.pmod(draw("choice", *seed), F.lit(2)) == 0, asked)


def parse_choice(answer: Column, a: Column, b: Column) -> Column:
    """'a', 'b' or null: the word after the first ``ANSWER:``, or the last word where there is none."""
    tagged = F.regexp_extract(answer, "(?i)ANSWER:\\s*([A-Za-z'-]+)", 1)
    last = F.element_at(F.concat(F.array(F.lit("")), whitespace_tokens(answer)), -1)
    word = F.lower(F.when(tagged != "", tagged).otherwise(last))
    return let(word, lambda w: F.when(w == F.lower(a), "a").when(w == F.lower(b), "b"))


def generation_prompt(task: str, signature: str, lang: str = "python", tight: bool = True) -> str:
    """Asks for a module of code that solves a task."""
    name = "C" if lang == "c" else "Python"
    parts = [f"Write a whole {name} module with the public entry {signature} that does this: {task}.", LENGTH]
    parts += ["Prefer loops to recursion."] * tight + ["Include no headers."] * (lang == "c")
    return " ".join([*parts, "Give the code only."])


def rewrite_prompt(code: str, signature: str, lang: str = "python", mode: str = "diversify") -> str:
    """Asks for the same behaviour in another structure, or (``canonical``) in the most usual one."""
    if mode not in ("diversify", "canonical"):
        raise ValueError(f"no mode {mode}")
    name = "C" if lang == "c" else "Python"
    how = "in the most usual textbook form, with plain local names and no comments" if mode == "canonical" else "with another inner structure (order of operands and statements, kinds of loops, temporaries), no comments"
    return f"Rewrite this {name} module {how}. Behaviour and the public entry {signature} stay. {LENGTH} Give the code only.\n\n{code}"


def reverse_prompt(topic: str) -> str:
    """Asks for a text whose sentences come last first, to be reversed afterwards."""
    return f"Write about {topic}, but give the sentences in reverse order: the last one first. {LENGTH} Give the text only."


def transcode_prompt(topic: str) -> str:
    """Asks for a text with the letters of each word reversed, to be decoded afterwards."""
    return f"Write about {topic} in English, but spell each word backwards, letter by letter; spaces and punctuation stay. {LENGTH} Give the text only."


def roundtrip_prompt(text: str, pivot: str = "Spanish") -> tuple[str, str]:
    """Asks for a translation, and for the way back (with ``{translation}`` to be filled in)."""
    return f"Translate into {pivot}, sentence by sentence, and give the translation only.\n\n{text}", "Translate into English, sentence by sentence, and give the translation only.\n\n{translation}"


def clean_answer(answer: Column) -> Column:
    """An answer without fences and without white space around it."""
    return strip(F.regexp_replace(answer, "```[a-zA-Z]*\\n?", ""))
