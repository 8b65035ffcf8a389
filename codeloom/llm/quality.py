"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every rule is a row of :data:`RULES`: a metric and the closed interval that it must lie in. The
metrics are expressions over the whole text (length, symbol, stop-word and line ratios); the
compiler turns the table into one column, so the plan is one scan and one projection: no shuffle,
no Python.

Defined results: a null text has no metrics and is rejected; an empty or blank text has 0 words and
is rejected by ``n_words``; ratios with nothing to divide by are 0. Rows are judged one by one, so
ties and repeated rows each get the same verdict; an empty table gives an empty table. A word is a
run of characters other than white space; of scripts written without spaces (Chinese, Japanese, Thai,
Lao, Khmer, Burmese) each character is one. Prose of a language without words in :data:`STOP_WORDS`
falls short of them and is rejected; a table without that rule serves it. Extra
columns pass through and may have any name: the rules read the text column only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ref

#: Frequent function words of the languages served, matched whole against lower-cased words.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with by an at this from be or not "
    "le la les de des du un une et en que qui dans pour par sur est au avec ce pas "
    "der die das und ist ein eine den dem von mit auf für nicht sich im zu es als auch "
    "el los las y se una con del por no su al lo como más "
    "的 一 是 了 我 不 在 有 他 这 就 和 の は に を た が で て と し"
).split()
#: Scripts written without spaces; each of their characters counts as a word.
_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
#: The share of stop words that prose has at least, and by how many words a text may fall short of it.
STOP_SHARE, STOP_SLACK = 0.02, 0.6
#: None of them has characters below U+0E00, so most text is passed over by one comparison a character.
_ALONE = "([\\x{E00}-\\x{10FFFF}&&[" + "".join(f"\\p{{Is{x}}}" for x in _SCRIPTS) + "]])"
SYMBOLS = "[#$%&*|~^<>{}\\[\\]\\\\=+_]"


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; None leaves that side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds.
RULES: tuple[Rule, ...] = (
    Rule("n_words", low=1),
    Rule("mean_word_chars", low=1.0, high=30.0),
    Rule("max_word_chars", high=1000),
    Rule("symbol_ratio", high=0.05),
    Rule("shout_ratio", high=0.2),
    Rule("repeat_ratio", high=0.2),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_shortfall", high=STOP_SLACK),
)


#: Names of the metrics, in the order of the report.
METRICS = ("n_chars", "n_words", "mean_word_chars", "max_word_chars", "symbol_ratio", "shout_ratio", "repeat_ratio", "dup_line_ratio", "stop_ratio", "stop_shortfall")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def metrics(text: Column) -> Column:
    """A struct of the metrics, all over the whole text; null for a null text.

    n_chars, n_words; mean_word_chars and max_word_chars; symbol_ratio, symbols a character;
    shout_ratio, exclamation marks a word; repeat_ratio, words equal to the word before, a word;
    dup_line_ratio, the share of non-blank lines that repeat an earlier line; stop_ratio, stop words
    a word; stop_shortfall, the stop words lacking to ``STOP_SHARE`` of the words, so that a short text
    without any lacks less than one word and a long one lacks many.
    """
    over = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    parts = F.struct(
        text.alias("t"),
        F.char_length(text).alias("c"),
        F.filter(F.split(F.lower(F.regexp_replace(text, _ALONE, " $1 ")), "\\s+"), lambda w: w != "").alias("ws"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("ls"),
    )

    def body(p: Column) -> Column:
        t, c, ws, ls = p["t"], p["c"], p["ws"], p["ls"]
        n = F.size(ws)
        lengths = F.transform(ws, lambda w: F.char_length(w))
        stop = F.size(F.filter(ws, lambda w: w.isin(STOP_WORDS)))
        return F.struct(
            c.cast("long").alias("n_chars"),
            n.cast("long").alias("n_words"),
            over(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), n).alias("mean_word_chars"),
            F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("max_word_chars"),
            over(F.regexp_count(t, F.lit(SYMBOLS)), c).alias("symbol_ratio"),
            over(c - F.char_length(F.replace(t, F.lit("!"), F.lit(""))), n).alias("shout_ratio"),
            over(F.size(F.filter(ws, lambda w, i: F.when(i > 0, w == F.get(ws, i - 1)).otherwise(F.lit(False)))), n).alias("repeat_ratio"),
            over(F.size(ls) - F.size(F.array_distinct(ls)), F.size(ls)).alias("dup_line_ratio"),
            over(stop, n).alias("stop_ratio"),
            F.round(F.greatest(n * STOP_SHARE - stop, F.lit(0.0)), 6).alias("stop_shortfall"),
        )

    return F.when(text.isNotNull(), _let(parts, body))


def verdict(measured: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean over a struct of metrics: all rules hold. False, never null, without metrics."""
    ok = measured.isNotNull()
    for r in rules:
        if r.metric not in METRICS:
            raise ValueError(f"no metric {r.metric}")
        if r.low is not None:
            ok = ok & (measured[r.metric] >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (measured[r.metric] <= F.lit(r.high))
    return F.coalesce(ok, F.lit(False))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows whose text keeps all rules, with all their columns."""
    return docs.filter(_let(metrics(ref(text)), lambda m: verdict(m, rules)))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and metrics of the rows that :func:`quality_filter` keeps."""
    kept = _let(metrics(ref(text)), lambda m: F.when(verdict(m, rules), m))
    return docs.select(ref(key).alias("k"), F.inline(F.filter(F.array(kept), lambda m: m.isNotNull()))).withColumnRenamed("k", key)


_IN = ", ".join("'" + w + "'" for w in STOP_WORDS)
_TESTS = " and ".join(t for r in RULES for t in ([f"{r.metric} >= {r.low}"] if r.low is not None else []) + ([f"{r.metric} <= {r.high}"] if r.high is not None else []))
_RE2 = "".join(f"\\p{{{x}}}" for x in _SCRIPTS)
ORACLE = rf"""
with w as (
  select doc_id, text, length(text) as c,
         list_filter(string_split_regex(lower(regexp_replace(text, '([{_RE2}])', ' \1 ', 'g')), '\s+'), lambda x: x <> '') as ws,
         list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ls
  from documents where text is not null
), m as (
  select doc_id, c::bigint as n_chars, len(ws)::bigint as n_words,
    case when len(ws) > 0 then round(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::double / len(ws), 6) else 0.0 end as mean_word_chars,
    coalesce(list_max(list_transform(ws, lambda x: length(x))), 0)::bigint as max_word_chars,
    case when c > 0 then round((c - length(regexp_replace(text, '[#$%&*|~^<>{{}}\[\]\\=+_]', '', 'g')))::double / c, 6) else 0.0 end as symbol_ratio,
    case when len(ws) > 0 then round((c - length(replace(text, '!', '')))::double / len(ws), 6) else 0.0 end as shout_ratio,
    case when len(ws) > 0 then round(len(list_filter(ws, lambda x, i: i > 1 and x = ws[i - 1]))::double / len(ws), 6) else 0.0 end as repeat_ratio,
    case when len(ls) > 0 then round((len(ls) - len(list_distinct(ls)))::double / len(ls), 6) else 0.0 end as dup_line_ratio,
    case when len(ws) > 0 then round(len(list_filter(ws, lambda x: x in ({_IN})))::double / len(ws), 6) else 0.0 end as stop_ratio,
    round(greatest(len(ws)::double * {STOP_SHARE} - len(list_filter(ws, lambda x: x in ({_IN}))), 0.0), 6) as stop_shortfall
  from w
)
select * from m where {_TESTS}
"""
