"""Line-first quality rules (operator 7), in DataFrame functions only.

Each line of a text is judged by punctuation (an end, few symbols), navigation and boilerplate rules; failing lines are
removed; a document that loses too large a share of its characters is rejected, as is one that fails
the base rules. Nothing is shuffled: every measure is a function of one row.

Defined cases: a null or blank text has no words, zero measures and base_failed true (too few words);
repeated rows are judged alike; an empty table gives an empty result; further columns are carried
through by `clean_lines`, and names that clash with its outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, read

#: Phrases of page furniture, matched in lower case anywhere in a line; `clean_lines` takes any others.
BOILERPLATE = [
    "all rights reserved",
    "alle rechte vorbehalten",
    "aviso legal",
    "click here",
    "cliquez ici",
    "cookie policy",
    "datenschutzerklärung",
    "enable javascript",
    "haga clic aquí",
    "hier klicken",
    "lorem ipsum",
    "mentions légales",
    "politique de confidentialité",
    "política de privacidad",
    "privacy policy",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
    "todos los derechos reservados",
    "tous droits réservés",
]
#: Characters that may stand last in a line that ends a sentence: full stops, question and exclamation marks of
#: Latin, Armenian, Arabic, Indic, Ethiopic, Burmese, Khmer, Thai and East Asian writing, colons, quotation marks and brackets.
ENDS = ".!?…‼⁇⁈⁉։؟۔।॥။።፧៕๚。！？｡:;؛\"'”’»」』)]）］》〉"
#: A sentence end inside a line. A line without an end is finished all the same if sentences fill it but for a tail of less than half of
#: it: texts without line breaks may be cut at their end.
INNER_END = "(?:[.!?…‼⁇⁈⁉։؟۔।॥။።፧][\"'”’»)]? |[。！？｡៕])"
_TAIL = f"(?s)^.*{INNER_END}"
#: Bars, arrows and bullets between entries of a menu: this many make a line a menu.
MENU = "|»›·•>"
MENU_MARKS = 3
MENU_LINE = f"(?:[{MENU}][^{MENU}]*){{{MENU_MARKS}}}"
#: Guillemets around a quotation are no marks of a menu, in either direction; what they enclose is judged.
QUOTED = "«([^«»]*)»|»([^«»]*)«|‹([^‹›]*)›|›([^‹›]*)‹"
#: Lines of any length, which may be whole texts, are judged by share: a menu has a mark for so many characters at least, and in
#: furniture the phrases are more than one character in so many.
MENU_ENTRY_CHARS = 30
FURNITURE_PART = 10
#: Characters that the measure n_symbols counts; a line with more than one in SYMBOL_PART is debris of mark-up.
SYMBOLS = "#*$%&|<>"
SYMBOL_PART = 5
MAX_LOST = 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def line_fails(line: Column, phrases: Sequence[str] = BOILERPLATE) -> Column:
    """True if any of the rules removes the line; a blank line never fails. phrases: of furniture, in lower case."""
    end = F.rtrim(line, F.lit(SPACES))
    length = F.length(F.ltrim(end, F.lit(SPACES)))
    unfinished = ~F.contains(F.lit(ENDS), F.right(end, F.lit(1))) & (2 * F.length(F.regexp_replace(end, _TAIL, "")) > length)
    # Most lines have no symbol, and only the first test is made for them.
    debris = end.rlike(f"[{SYMBOLS}]") & (SYMBOL_PART * (F.length(end) - F.length(F.regexp_replace(end, f"[{SYMBOLS}]+", ""))) > length)
    bare = F.regexp_replace(end, QUOTED, "$1$2$3$4")
    # Most lines have no three marks, and only the first test is made for them.
    menu = end.rlike(MENU_LINE) & bare.rlike(MENU_LINE) & (MENU_ENTRY_CHARS * (F.length(bare) - F.length(F.regexp_replace(bare, f"[{MENU}]+", ""))) > length)
    low = F.lower(line)
    furniture = F.lit(False)
    for phrase in phrases:
        furniture = furniture | low.contains(phrase)
    if phrases:
        furniture = furniture & (FURNITURE_PART * (F.length(low) - F.length(F.regexp_replace(low, "|".join(map(re.escape, phrases)), ""))) > length)
    return (end != "") & (unfinished | debris | menu | furniture)


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST, phrases: Sequence[str] = BOILERPLATE) -> DataFrame:
    """docs with the base measures, `clean_text`, `n_removed_lines`, `lost_share`, `base_failed` and `kept`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.withColumns({"words": _words(text), "lines": F.split(text, "\n", -1)})
    two = one.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
            "full_lines": F.filter("lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            "judged": F.transform("lines", lambda x: F.struct(x.alias("line"), line_fails(x, phrases).alias("fails"))),
            "windows": F.expr("transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)))"),
        }
    )
    # A window found twice: its hash stands beside an equal one once sorted. Texts without any skip the sort by position.
    two = two.withColumns({k: F.transform(F.filter("judged", rule), lambda x: x["line"]) for k, rule in (("good_lines", lambda x: ~x["fails"]), ("bad_lines", lambda x: x["fails"]))})
    three = two.withColumn("n_dup_lines", (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long")).withColumn(
        "ranked",
        F.expr("if(size(words) < 3 or size(array_distinct(windows)) = size(windows), cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))))"),
    )
    four = three.withColumn(
        "at",
        F.expr("sort_array(transform(filter(ranked, (x, k) -> coalesce(x.h = get(ranked, k - 1).h, false) or coalesce(x.h = get(ranked, k + 1).h, false)), x -> x.i))"),
    )
    five = four.withColumn(
        "n_repeat_words",
        F.expr("cast(if(size(at) = 0, 0, 3 + aggregate(zip_with(slice(at, 2, size(at)), slice(at, 1, size(at) - 1), (a, b) -> least(3, a - b)), 0, (s, x) -> s + x)) as bigint)"),
    )
    lost = F.length(F.regexp_replace(F.array_join("bad_lines", "\n"), SPACE_CLASS + "+", ""))
    return (
        five.withColumns(
            {
                "clean_text": F.array_join("good_lines", "\n"),
                "n_removed_lines": F.size("bad_lines").cast("long"),
                "lost_share": F.when(F.size("bad_lines") > 0, lost / F.col("word_chars")).otherwise(F.lit(0.0)),
                "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            }
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
        .drop("words", "lines", "judged", "full_lines", "good_lines", "bad_lines", "windows", "ranked", "at")
    )


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines")


_Q, _INNER = ENDS.replace("'", "''"), INNER_END.replace("'", "''")
_BARE = f"regexp_replace(b, '{QUOTED}', '\\1\\2\\3\\4', 'g')"
_FAILS = f"""(b <> '' and (
  (not contains('{_Q}', right(b, 1)) and 2 * length(regexp_replace(b, '(?s)^.*{_INNER}', '')) > length(b))
  or {SYMBOL_PART} * (length(b) - length(translate(b, '{SYMBOLS}', ''))) > length(b)
  or (regexp_matches({_BARE}, '{MENU_LINE}') and {MENU_ENTRY_CHARS} * (length({_BARE}) - length(translate({_BARE}, '{MENU}', ''))) > length(b))
  or (({" or ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)})
    and {FURNITURE_PART} * (length(lower(l)) - length(regexp_replace(lower(l), '{"|".join(BOILERPLATE)}', '', 'g'))) > length(b))))"""

OP7_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, string_split(text, chr(10)) as lines from d),
pos as (select rid, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3),
tri as (select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from pos),
hit as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from tri) where n > 1),
cov as (select rid, count(distinct i + o) as n from hit, (values (0), (1), (2)) as t(o) group by rid),
ln as (select rid, unnest(lines) as l, generate_subscripts(lines, 1) as k from w),
lb as (select rid, l, k, trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b from ln),
lf as (select rid, count(*) filter (b <> '') - count(distinct l) filter (b <> '') as n_dup, count(*) filter ({_FAILS}) as n_bad,
  coalesce(sum(length(translate(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))) filter ({_FAILS}), 0) as bad_chars from lb group by rid),
m as (select w.doc_id, len(words)::bigint as n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
  coalesce(n_bad, 0)::bigint as n_removed_lines, coalesce(bad_chars, 0) as bad_chars
  from w left join cov using (rid) left join lf using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and bad_chars <= {MAX_LOST} * word_chars as kept, n_removed_lines from m
"""
