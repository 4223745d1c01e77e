"""Scalar column functions: words, tags, roles, arcs and characters. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tags

#: What Python's float() reads, once commas are gone.
NUMBER = r"^[ \t\n\r]*[+-]?(([0-9]+(_[0-9]+)*)?\.?([0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?|[0-9]+(_[0-9]+)*\.([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])[ \t\n\r]*$"
THAI = "\\u0e01-\\u0e5b"


def _lookup(column: Column, table: dict[str, str], default: Column) -> Column:
    """Value of column in a fixed table, as one map literal."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), default)


def normalise_words(tokens: DataFrame) -> DataFrame:
    """tokens with word: proper names as <npn>, numbers as <num>, spaces as _."""
    plain = F.regexp_replace("word", ",", "")
    word = F.when(F.col("pos") == "npn", "<npn>").when(plain.rlike(NUMBER), "<num>").otherwise(F.regexp_replace("word", " ", "_"))
    return tokens.withColumn("word", word)


def encode_punc(word: Column) -> Column:
    return _lookup(word, tags.PUNCTUATION, word)


def decode_punc(word: Column) -> Column:
    return _lookup(word, {v: k for k, v in tags.PUNCTUATION.items()}, word)


def simplify_pos(pos: Column) -> Column:
    return _lookup(pos, tags.COARSE, F.upper(pos))


def role_class(role: Column) -> Column:
    """complement, adjunct or unknown, by the part before a slash."""
    first = F.split_part(role, F.lit("/"), F.lit(1))
    return F.when(first.isin(tags.COMPLEMENTS), "complement").when(first.isin(tags.ADJUNCTS), "adjunct").otherwise("unknown")


def is_content_word(pos: Column) -> Column:
    return pos.isin(tags.CONTENT)


def arc_distance(i: Column, j: Column) -> Column:
    """Words between i and j, five at most."""
    return F.least(F.abs(i - j) - 1, F.lit(5))


def arc_direction(head: Column, child: Column) -> Column:
    """L if the head is right of the child."""
    return F.when(head > child, "L").otherwise("R")


def compatible_tags(pos: Column) -> Column:
    """Tags that agree with pos: itself, and common and proper nouns with prefixes."""
    more = F.when(pos.isin(tags.PREFIXES), F.array(F.lit("ncn"), F.lit("npn"))).when(pos.isin("ncn", "npn"), F.array(*map(F.lit, tags.PREFIXES)))
    return F.concat(F.array(pos), F.coalesce(more, F.array().cast("array<string>")))


def compatible_pos(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a.pos, b.pos) that agree, as an equi-join on the tags that go with a.pos."""
    wide = a.select("pos", F.explode(compatible_tags(F.col("pos"))).alias("other"))
    return wide.join(b.select(F.col("pos").alias("other")), "other").select("pos", "other")


def split_scripts(text: Column) -> Column:
    """Runs of Thai and of other characters."""
    return F.regexp_extract_all(text, F.lit(f"([{THAI}]+|[^{THAI}]+)"), F.lit(1))


# Characters by class; 1 vowels and marks above or below, 2 vowels before, 3 vowels after, 4 consonants.
CHARACTER_CLASSES = {"1": "\u0e31\u0e34-\u0e3a\u0e47-\u0e4e", "2": "\u0e40-\u0e44", "3": "\u0e30\u0e32\u0e33", "4": "\u0e01-\u0e2e"}
# Class sequences that are not cut.
CLUSTERS = ["413", "431", "411", "241", "41", "43", "24"]


def char_clusters(text: Column) -> Column:
    """Leftmost clusters of three, then two characters; a cluster does not end the text; else single characters."""
    whole = "|".join("".join(f"[{CHARACTER_CLASSES[c]}]" for c in x) for x in CLUSTERS)
    return F.regexp_extract_all(text, F.lit(rf"((?:{whole})(?=[\s\S])|[\s\S])"), F.lit(1))


def is_symbol(word: Column) -> Column:
    """One printable ASCII character that is no blank."""
    return word.rlike("^[!-~]$")


def is_number(word: Column) -> Column:
    """Arabic or Thai digits, with , and . where the word is longer than one."""
    return word.rlike(r"^([0-9\u0e50-\u0e59]|[0-9\u0e50-\u0e59,.]{2,})$")


def is_thai_char(word: Column) -> Column:
    """One character that is neither a symbol nor a digit."""
    return (F.char_length(word) == 1) & ~is_symbol(word) & ~is_number(word)


def is_thai_word(word: Column) -> Column:
    return word.rlike(r"^[^!-~\u0e50-\u0e59 \t\n\x0b\f\r]*$")
