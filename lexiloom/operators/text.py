"""Tokens and token filters. A filter takes and returns a table with a column `word`, so that filters chain by df.transform()."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Filter = Callable[[DataFrame], DataFrame]

#: Script of each language (fixed values); a language that is not here keeps all its words.
SCRIPTS = {"en": "Latin", "de": "Latin", "fr": "Latin", "bn": "Bengali", "hi": "Devanagari", "mr": "Devanagari", "kn": "Kannada", "ml": "Malayalam", "ta": "Tamil", "te": "Telugu"}


#: What split_words() cuts at, for engines whose white space is ASCII only: all white space but the space, and any run of white space
#: that is not a single space.
_NOT_SPACE = r"\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES_TO_ONE = rf" [ {_NOT_SPACE}]+|[{_NOT_SPACE}][ {_NOT_SPACE}]*"


def split_words(text: Column) -> Column:
    """Runs between Unicode white space; empty strings where text begins or ends with it."""
    return F.split(text, r"(?U)\s+")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: bool = True, keep: Iterable[str] = ()) -> DataFrame:
    """(lang, doc_id, keep, pos, word): the words of every document; pos counts from 0."""
    text = F.lower(text_col) if lower else F.col(text_col)
    return docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"), *keep, F.posexplode(split_words(text)).alias("pos", "word")).where("word <> ''")


def keep_all() -> Filter:
    return lambda df: df


def drop_words(df_words: DataFrame, *more: DataFrame) -> Filter:
    """Without the words of one or more lists (column word)."""
    return lambda df: df.join(_all_words(df_words, more), "word", "left_anti")


def keep_words(df_words: DataFrame, *more: DataFrame) -> Filter:
    """Only words of one or more lists (column word)."""
    return lambda df: df.join(_all_words(df_words, more), "word", "left_semi")


def _all_words(first: DataFrame, more: Iterable[DataFrame]) -> DataFrame:
    out = first.select("word")
    for x in more:
        out = out.unionByName(x.select("word"))
    return out.distinct()


def at_least(characters: int = 3) -> Filter:
    return lambda df: df.where(F.length("word") >= characters)


def foreign(word: Column, lang: Column) -> Column:
    """Whether a word has a character of another script than its language's."""
    found = F.lit(False)
    for name in sorted(set(SCRIPTS.values())):
        langs = [k for k, v in SCRIPTS.items() if v == name]
        found = found | (F.coalesce(lang.isin(langs), F.lit(False)) & word.rlike(rf"\P{{Is{name}}}"))
    return found


def has_word(text: Column, lang: Column, characters: int = 3) -> Column:
    """Whether a text has a word of so many characters at least that is not foreign(); it is read up to the first such word only."""
    word = lambda kind: text.rlike(rf"(?U)(?<!\S){kind}{{{characters},}}+(?!\S)")
    found = word(r"\S")
    for name in sorted(set(SCRIPTS.values())):
        found = F.when(lang.isin([k for k, v in SCRIPTS.items() if v == name]), word(rf"\p{{Is{name}}}")).otherwise(found)
    return found


def in_script(script: str | None = None, lang: str | None = None, lang_col: str | None = None) -> Filter:
    """Words wholly in one script: any other character, digits and punctuation too, drops a word. The script is given, or that of
    a language, or of each row's language; without any, and for unknown languages, all words stay."""
    if lang_col:
        return lambda df: df.where(~foreign(F.col("word"), F.col(lang_col)))
    script = script or SCRIPTS.get(lang or "", "ALL")
    return keep_all() if script == "ALL" else lambda df: df.where(~F.col("word").rlike(rf"\P{{Is{script}}}"))


def reassembled(words: DataFrame, keys: list[str], name: str = "text") -> DataFrame:
    """(keys, text): words in order of pos, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return words.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias(name))


def preprocessed(lines: DataFrame, stop: DataFrame, key: str, text_col: str = "text", least: int = 3, lang_col: str = "lang") -> DataFrame:
    """(key, text): each line without stop words, short words and words of another script; a line that loses all stays as ''."""
    words = tokens(lines, key, text_col, lang_col, lower=False).withColumnRenamed("doc_id", key)
    kept = words.transform(drop_words(stop)).transform(at_least(least)).transform(in_script(lang_col="lang"))
    return lines.select(key).join(reassembled(kept, [key]), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def on_vocabulary(words: DataFrame, vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents reduced to words of a vocabulary (lang, word), in order; empty documents stay."""
    kept = words.join(vocab.select("lang", "word"), ["lang", "word"], "left_semi")
    return docs.select("doc_id").join(reassembled(kept, ["doc_id"]), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
