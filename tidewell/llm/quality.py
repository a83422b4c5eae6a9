"""Line-first quality rules, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, and what lies between them.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: A document that loses more than this share of its lines' characters is rejected.
MOST_LOST_PERCENT = 50

#: A line of prose has the end of a sentence somewhere.
SENTENCE_END = r"""[.!?\x{2026}\x{3002}]['")\]\x{00BB}\x{201D}\x{2019}]*([\x20\x09-\x0D]|\z)"""
#: Menus and bread crumbs: two or more separators with blanks around them, in a line that does not close as a sentence and quotes nothing.
SEPARATED = r"[\x20\x09][|\x{00BB}\x{203A}>\x{2022}\x{00B7}][\x20\x09].*[\x20\x09][|\x{00BB}\x{203A}>\x{2022}\x{00B7}][\x20\x09]"
QUOTED = r"[\x{00AB}\x{2039}]"
CLOSED = r"""[.!?\x{2026}\x{3002}]['")\]\x{00BB}\x{201D}\x{2019}]*[\x20\x09-\x0D]*\z"""
#: Entries of menus, which are navigation where they are all of a line.
MENU = ("home", "menu", "search", "next", "previous", "back", "share", "contact", "about us", "site ?map", "accueil", "recherche", "suivant", "pr[\\x{00E9}\\x{00C9}]c[\\x{00E9}\\x{00C9}]dent", "startseite", "suche", "weiter", "zur[\\x{00FC}\\x{00DC}]ck", "kontakt", "inicio", "buscar", "siguiente", "anterior", "contacto")
#: What pages say about themselves.
PHRASES = (
    "we use cookies", "uses cookies", "cookie (policy|settings|preferences|consent|notice)", "accept (all )?cookies", "enable javascript", "javascript is (disabled|required)", "terms of (use|service)", "privacy policy",
    "all rights reserved", "click here", "read more", "sign up", "log in", "lorem ipsum", "subscribe to", "share this", "tous droits r[\\x{00E9}\\x{00C9}]serv[\\x{00E9}\\x{00C9}]s", "politique de confidentialit[\\x{00E9}\\x{00C9}]",
    "cliquez ici", "lire la suite", "alle rechte vorbehalten", "datenschutzerkl[\\x{00E4}\\x{00C4}]rung", "hier klicken", "weiterlesen", "todos los derechos reservados", "pol[\\x{00ED}\\x{00CD}]tica de privacidad", "haga clic aqu[\\x{00ED}\\x{00CD}]", "leer m[\\x{00E1}\\x{00C1}]s",
)
NAVIGATION = rf"(?i)\A[\x20\x09-\x0D]*({'|'.join(MENU)})[\x20\x09-\x0D]*\z"
BOILERPLATE = rf"(?i)({'|'.join(PHRASES)})"
#: A line is boilerplate if such phrases make up so much of it, in percent: prose may mention one.
MOST_BOILERPLATE_PERCENT = 15
#: The most of a line's characters, in percent, that may be symbols, or doubled exclamation marks.
MOST_SYMBOLS_PERCENT = 10


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def line_passes(line: Column) -> Column:
    """Whether a line passes the rules on punctuation, navigation and boilerplate; null for a null line, false for an empty one.

    It passes with the end of a sentence somewhere, few symbols and doubled exclamation marks, no menu, and little of it set phrases.
    """
    odd = F.greatest(F.length(line) - F.length(_without(line, SYMBOLS)), F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit(""))))
    prose = (odd * 100 <= F.length(line) * MOST_SYMBOLS_PERCENT) & line.rlike(SENTENCE_END)
    menu = line.rlike(NAVIGATION) | (line.rlike(SEPARATED) & ~line.rlike(QUOTED) & ~line.rlike(CLOSED))
    phrases = F.when(line.rlike(BOILERPLATE), (F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))) * 100 > F.length(line) * MOST_BOILERPLATE_PERCENT).otherwise(False)
    return prose & ~menu & ~phrases


def _doubled(hashes: Column, j: int) -> Column:
    """The hash of each of the hashes and the j-th after it, as far as there is one."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - j, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + j)))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts, base_failed, kept and clean_text.

    n_words counts words ``[^\\x20\\x09-\\x0D]+``, word_chars their code points, n_symbols the characters ``[#*$%&|<>]``, n_dup_lines
    the lines with a word that equal an earlier line, n_repeat_words the words in an 8-word window that occurs twice or more
    in the text, the first included. base_failed: fewer than 20 words, or over 30 % repeated words. clean_text has the lines
    that pass line_passes(), and those without a word. kept: not base_failed, and no more than half of the characters of
    lines with a word are lost. A null text counts as an empty one, which fails. Ids are passed through, nulls and repeated
    ones too; other columns are not read.

    Every count is made within its row, in linear time (n log n where windows repeat), so that nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    lines = F.split("t", "\n", -1)
    out = out.select("doc_id", "t", F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)).alias("w"), F.filter(lines, lambda x: x.rlike(WORD)).alias("lines"), lines.alias("all_lines"))
    n = F.size("w")
    out = out.withColumns({"n_words": n.cast("long"), "good": F.filter("all_lines", lambda x: line_passes(x) | ~x.rlike(WORD))}).drop("all_lines")
    # hashes of 2, 4 and 8 words, each of two of half as many
    for j in (1, 2, 4):
        out = out.withColumn("w", _doubled(F.col("w"), j))
    out = out.withColumnRenamed("w", "g")
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    out = out.withColumn("s", F.when(repeats, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("s", lambda e, j: (F.get("s", j - 1)["x"] == e["x"]) | F.coalesce(F.get("s", j + 1)["x"] == e["x"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct((i + REPEAT_WINDOW).alias("end"), (a["n"] + i + REPEAT_WINDOW - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    chars = lambda c: F.length(F.concat_ws("", c))
    out = out.select(
        "doc_id",
        "n_words",
        F.length(_without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        chars("lines").alias("before"),
        chars(F.filter("good", lambda x: x.rlike(WORD))).alias("after"),
        F.concat_ws("\n", "good").alias("clean_text"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    kept = ~failed & ((F.col("before") - F.col("after")) * 100 <= F.col("before") * MOST_LOST_PERCENT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "clean_text")
