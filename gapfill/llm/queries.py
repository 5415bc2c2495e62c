"""The registered queries of the operators, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfill.session import materialize

from . import (
    alignment,
    chat,
    decontam,
    interpolation,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality_model,
    quality_rules,
    site_tree,
    url_filter,
    whitening,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks side by side, as the SQL has them, not the windows that :func:`line_dedup.find` uses by itself."""
    got = line_dedup.find(table(spark, sf, "documents").select("doc_id", "text"), line_dedup.FAMILIES)
    return got.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("removed", lambda i: i.cast("string"))).alias("removed_lines"),
    )


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_model.classify(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf, "documents").select("doc_id", "text")))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents").select("doc_id", "text"), keep_ids=False)
    return packing.step_groups(materialize(packed, "packing"))


def op5_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a URL: the quality of the document with the page's number; documents and pages have no other key."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_filter.judge(pages, pages.join(labels, "page_id").select("url", "bad"))


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    got = quality_rules.judge(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return got.drop("char_distance", "word_distance")


def op8_site_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    return site_tree.extract(table(spark, sf, "pages").select("page_id", "url", "html"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = decontam.contamination(docs, table(spark, sf, "benchmark").select("item_id", "text"))
    return got.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op10_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                                    F.lit(role).alias("role"), F.lit(odd).alias("text")) for i, role in enumerate(("user", "assistant")))))
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = materialize(chat.chains(turns), "chat-messages")
    got = chat.format_branches(messages)
    conv = F.substring_index("root", "/", 1)
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        F.when(conv != "null", conv).cast("long").alias("conv_id"),
        F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf, "documents").select("doc_id", "text"))


def op12_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return interpolation.score(table(spark, sf, "documents").select("doc_id", "text"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS9 = rf"regexp_extract_all(translate(text, {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
with items as (select cast(item_id as varchar) as item, {_WORDS9} as w from benchmark),
grams as (select distinct item, least(len(w), 10) as n, list_slice(w, i, i + least(len(w), 10) - 1) as gram
          from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
docs as (select doc_id, row_number() over () as row, coalesce({_WORDS9}, []) as w from documents),
sizes as (select distinct n from grams),
windows as (select row, n, i, list_slice(w, i, i + n - 1) as gram
            from (select row, n, w, unnest(range(1, len(w) - n + 2)) as i from docs, sizes)),
found as (select row, i, n, item from windows join grams using (n, gram)),
hit as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + n)) as p from found) group by row),
named as (select row, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct row, item from found) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (row) left join named using (row)"""

_COMMON = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in quality_rules.COMMON_WORDS)
_CLASS = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": "0-9", "stop": ".,;:!?''\"()-", "symbol": "#*$%&|<>"}
_CHARS = ", ".join(f"length(regexp_replace(t, '[^{c}]+', '', 'g'))" for c in _CLASS.values())
_SPACE = r"[\x20\x09-\x0D]+"


def _part(p: str, q: str, i: int) -> str:
    a, b = f"{p}[{i}]", f"{q}[{i}]"
    return " + ".join(f"case when {x} > 0 then {x} * log2({x} / (({a} + {b}) / 2)) else 0.0 end" for x in (a, b))


def _distance(p: str, q: str, n: int) -> str:
    return "sqrt(greatest((" + " + ".join(_part(p, q, i) for i in range(1, n + 1)) + ") / 2, 0))"


_N_CHAR, _N_WORD = len(quality_rules.CHAR_CLASSES) + 1, len(quality_rules.COMMON_WORDS) + 1

OP7_SQL = f"""
with docs as (select doc_id, row_number() over () as row, coalesce(lang, '') as lang, coalesce(text, '') as t,
                     regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
lines as (select row, count(*) - count(distinct line) as n_dup_lines
          from (select row, unnest(string_split(t, chr(10))) as line from docs)
          where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row),
grams as (select row, i, list_slice(w, i, i + 2) as g
          from (select row, w, unnest(range(1, len(w) - 1)) as i from docs where len(w) > 2)),
twice as (select row, i from (select row, i, count(*) over (partition by row, g) as c from grams) where c > 1),
rep as (select row, count(distinct p) as n_repeat_words from (select row, unnest(range(i, i + 3)) as p from twice) group by row),
base as (select doc_id, row, lang, cast(len(w) as bigint) as n_words,
                length(regexp_replace(t, '{_SPACE}', '', 'g')) as word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
                coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
                [{_CHARS}] as c, [{_COMMON}] as k
         from docs left join lines using (row) left join rep using (row)),
shares as (select *, list_transform(list_append(c, word_chars - list_sum(c)), lambda x: cast(x as double) / word_chars) as pc,
                  list_transform(list_append(k, n_words - list_sum(k)), lambda x: cast(x as double) / n_words) as pw
           from base),
refs as (select lang, [{", ".join(f"round(avg(pc[{i}]), 9)" for i in range(1, _N_CHAR + 1))}] as qc,
                [{", ".join(f"round(avg(pw[{i}]), 9)" for i in range(1, _N_WORD + 1))}] as qw
         from shares where n_words >= {quality_rules.MIN_WORDS} group by lang),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
                  case when n_words < {quality_rules.MIN_WORDS} then false
                       else {_distance("pc", "qc", _N_CHAR)} > {quality_rules.MAX_CHAR_DISTANCE}
                         or {_distance("pw", "qw", _N_WORD)} > {quality_rules.MAX_WORD_DISTANCE} end as far
           from shares left join refs using (lang))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(far, false) as kept from judged"""

_RULES6 = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
_TOKENS6 = r"""list_sort(list_distinct(
    list_transform(l[len(l):], lambda x: 'tld:' || x) || list_transform(l[len(l) - 1:len(l) - 1], lambda x: 'name:' || x)
    || list_transform(l[1:greatest(len(l) - 2, 0)], lambda x: 'sub:' || x)
    || list_transform(list_filter(flatten(list_transform(list_filter(l, lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'word:' || x)
    || list_transform(s[1:1], lambda x: 'dir:' || x) || list_transform(s[2:], lambda x: 'segment:' || x)
    || list_filter(['ending:' || regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)], lambda x: x <> 'ending:')
    || list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'query:' || x)))"""

OP6_SQL = f"""
with rules(rh, rp, rv) as (values {_RULES6}),
cut as (select page_id, row_number() over () as row, url,
               case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
urls as (select page_id, row, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}) as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) as query from cut),
tok as (select *, {_TOKENS6} as tokens
        from (select *, list_filter(string_split(host, '.'), lambda x: x <> '') as l,
                list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '0', 'g')) as s from urls)),
given as (select row, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as verdict
          from urls, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by row),
lab as (select row, tokens, quality = 0 as bad from tok join labels on page_id = doc_id
        where quality is not null and url is not null),
n as (select count(*) as n, greatest({url_filter.MIN_SUPPORT}, {url_filter.MIN_COUNT} / count(*)) as least from lab),
parts as (select row, bad, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) as a
          from (select row, bad, tokens, unnest(range(1, 1 << len(tokens))) as m from lab)),
sup as (select a, count(*) as total, count(*) filter (bad) as b, count(*) filter (not bad) as g from parts group by a),
mined as (select a, verdict, k / total as confidence, k as support, round(cast(k as double) / total / (cast(base as double) / n), 9) as lift
          from (select a, total, 'block' as verdict, b as k, (select count(*) from lab where bad) as base from sup
                union all select a, total, 'allow', g, (select count(*) from lab where not bad) from sup), n
          where k >= ceil(least * n) and k > 0 and cast(k as double) / total >= {url_filter.MIN_CONFIDENCE}
            and round(cast(k as double) / total / (cast(base as double) / n), 9) >= 1),
best as (select row, max({{'l': lift, 'c': confidence, 's': support, 'n': len(a), 'mined_rule': array_to_string(a, ' '), 'verdict': verdict}}) as m
         from tok join mined on list_has_all(tokens, a) where row not in (select row from given) group by row)
select page_id, host, path, rule, coalesce(given.verdict, m.verdict, 'allow') as verdict, m.mined_rule as mined_rule
from tok left join given using (row) left join best using (row)"""

OP10_SQL = r"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(regexp_replace(role || text, '[\\#<]', '\\\0', 'g')) + 17) as formatted_chars
from turns group by conv_id"""

_LONG, _LEAST = line_dedup.LONG_WORDS, line_dedup.MIN_WORDS
_FAMILIES = ", ".join(f"({i}, {f}, {alone})" for i, (f, alone) in enumerate(line_dedup.FAMILIES))

OP1_SQL = f"""
with docs as (select doc_id, row_number() over () as row, md5(text) as key, text from documents),
cut as (select row, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i
        from docs where text <> ''),
lines as (select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words,
                 cast('0x' || substr(md5(line), 1, 8) as bigint) as h from cut),
fam(f, factor, alone) as (values {_FAMILIES}, ({line_dedup.WHOLE}, 0, false)),
roll as (select f, row, i, line, words,
                f < {line_dedup.WHOLE} and (
                  (coalesce(lag(h) over w, 0)::hugeint * factor + h) % {line_dedup.MODULUS} % {line_dedup.DIVISOR} = 0
                  or alone and (words >= {_LONG} or coalesce(lead(words) over w, 0) >= {_LONG})) as ends
         from lines, fam window w as (partition by f, row order by i)),
numbered as (select *, coalesce(sum(cast(ends as int)) over (partition by f, row order by i rows between unbounded preceding and 1 preceding), 0) as c
             from roll),
chunk as (select f, row, c, min(i) as start, count(*) as n, sum(words) as words, string_agg(line, chr(10) order by i) as chunk
          from numbered group by f, row, c),
counted as (select * from chunk where words >= {_LONG} or (n > 1 and words >= {_LEAST})),
ranked as (select c.row, start, n, dense_rank() over (partition by f, chunk order by doc_id nulls last, key, start) as place
           from counted c join docs using (row)),
gone as (select distinct row, unnest(range(start, start + n)) as i from ranked where place > 1)
select doc_id, case when coalesce(text, '') = '' then 0 else len(string_split(text, chr(10))) end as n_lines,
       coalesce(n, 0) as n_removed, coalesce(removed, '') as removed_lines
from docs left join (select row, count(*) as n, string_agg(cast(i as varchar), ',' order by i) as removed from gone group by row) using (row)"""

QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_site_style_tree": op8_site_style_tree,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
    "op11_token_alignment": op11_token_alignment,
    "op12_lm_score": op12_lm_score,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op6_url_filter": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_chat_format": OP10_SQL,
}
