"""Retrieval-prompted imputation: rendering, examples, prompts, completions, gates."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from checks.features import grams_sql, tfidf_sql
from checks.fixtures import duck_with, fixture, query, table
from checks.impute import BLANK
from checks.inject import GRID_SQL, grid
from gapfill.functions.scores import (
    extract_completion,
    lexicon_gate,
    severity_bucket,
    severity_guidance,
    valid_completion,
)
from gapfill.functions.text import metadata_text, render_value, row_payload
from gapfill.operators.examples import example_corpus, topk_examples
from gapfill.operators.neardup import exact_dup_gate, near_dup_gate
from gapfill.operators.prompts import PromptTemplate, complete
from gapfill.plans.prompt_impute import PromptImputer
from gapfill.plans.versions import impute_grid
from gapfill.session import materialize, scratch_path
from gapfill.sources.results import read_log, write_log

HINTS = {"target_group": "language of the text", "absent": "never shown", "intent": "rating from 1 to 5"}
HIGH = ("ation", "ment")
MEDIUM = ("the", "que")


@query(
    "render_values",
    f"""{duck_with('ev_holes')} SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
        CASE WHEN value IS NULL OR isnan(value) THEN '未知' ELSE printf('%.3f', value) END AS value,
        CASE WHEN event_type = '' THEN '未知' ELSE event_type END AS event_type,
        CASE WHEN date_part('us', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
             ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts,
        CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END AS even FROM ev_holes""",
)
def render_values(spark, sf):
    df = fixture(spark, sf, "ev_holes").withColumn("even", F.col("user_id") % 2 == 0)
    names = ("user_id", "value", "event_type", "ts", "even")
    return df.select("event_id", *[render_value(c, df.schema[c].dataType).alias(c) for c in names])


META_SQL = """('target_group: ' || target_group || ' predicted_author: ' || predicted_author || ' toxicity_human: '
    || printf('%.3f', toxicity_human) || ' intent: ' || printf('%.3f', intent) || ' framing: '
    || CASE WHEN framing IS NULL OR framing = '' THEN '未知' ELSE framing END || ' actual_method: ' || actual_method)"""


@query("metadata_text", f"{duck_with('doc_holes')} SELECT row_id, {META_SQL} AS metadata FROM doc_holes")
def metadata_of(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    return df.select("row_id", metadata_text(df, "text", ("row_id",)).alias("metadata"))


_PAYLOAD_SQL = """to_json({{text: {text}, target_group: target_group, predicted_author: predicted_author,
    toxicity_human: toxicity_human, intent: intent,
    framing: CASE WHEN framing IS NULL OR framing = '' THEN '未知' ELSE framing END, actual_method: actual_method}})"""


@query(
    "row_payload",
    f"{duck_with('doc_holes')} SELECT row_id, {_PAYLOAD_SQL.format(text='text')} AS payload FROM doc_holes",
)
def row_payload_of(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    return df.select("row_id", row_payload(df, "text", True, ("row_id",)).alias("payload"))


_SEVERITY = """CASE WHEN toxicity_human >= 3.5 THEN 'high' WHEN toxicity_human >= 2.5 THEN 'medium'
    WHEN toxicity_human >= 1.5 THEN 'low' WHEN toxicity_human IS NULL THEN 'unknown' ELSE 'benign' END"""
_GUIDANCE = f"('toxicity_human=' || CAST(toxicity_human AS VARCHAR) || ' -> expected level ' || upper({_SEVERITY}))"


@query(
    "severity_bucket",
    f"{duck_with('doc_base')} SELECT row_id, {_SEVERITY} AS level, {_GUIDANCE} AS guidance FROM doc_base",
)
def severity_of(spark, sf):
    return fixture(spark, sf, "doc_base").select(
        "row_id",
        severity_bucket("toxicity_human").alias("level"),
        severity_guidance("toxicity_human", "toxicity_human").alias("guidance"),
    )


_CORPUS = f"""meta AS (SELECT row_id, {META_SQL} AS m, {BLANK} AS blank, * EXCLUDE (row_id) FROM doc_holes),
  complete AS (SELECT * FROM meta WHERE NOT blank), {grams_sql('complete', 'row_id', 'm', 2, 'cg')},
  {tfidf_sql('cg', '(SELECT count(*) FROM complete)', 8000, 'cw')}"""


@query("example_corpus", f"{duck_with('doc_holes')}, {_CORPUS} SELECT k AS row_id, term, round(w, 6) AS weight FROM cw")
def example_corpus_of(spark, sf):
    return example_corpus(fixture(spark, sf, "doc_holes"), "row_id").weights().withColumn("weight", F.round("weight", 6))


# Weights depend on the metadata alone: score distinct metadata, then expand to rows.
_EXAMPLES = f"""{_CORPUS},
  asked AS (SELECT m, min(row_id) AS row_id FROM meta WHERE blank GROUP BY m), {grams_sql('asked', 'row_id', 'm', 2, 'qg')},
  qw AS (SELECT k, term, count(*) * (ln((1 + (SELECT count(*) FROM complete)) / CAST(1 + any_value(df) AS DOUBLE)) + 1) AS w
     FROM qg JOIN cw_v USING (term) GROUP BY k, term),
  qn AS (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM qw),
  firsts AS (SELECT m, min(row_id) AS row_id FROM complete GROUP BY m),
  scored AS (SELECT qn.k AS profile, cw.k AS first_id, round(sum(qn.w * cw.w), 9) AS score FROM qn
     JOIN cw USING (term) JOIN firsts ON firsts.row_id = cw.k GROUP BY ALL),
  rows_ AS (SELECT a.row_id AS profile, c.row_id AS example_key, coalesce(score, 0) AS score FROM asked a CROSS JOIN complete c
     JOIN firsts f ON f.m = c.m LEFT JOIN scored s ON s.profile = a.row_id AND s.first_id = f.row_id),
  picked AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, example_key) AS rank FROM rows_
     QUALIFY rank <= 5),
  examples AS (SELECT meta.row_id, rank, example_key, score FROM meta JOIN asked ON asked.m = meta.m
     JOIN picked ON profile = asked.row_id WHERE blank)"""


@query(
    "topk_examples",
    f"{duck_with('doc_holes')}, {_EXAMPLES} SELECT row_id, rank, example_key, round(score, 6) AS score FROM examples",
)
def topk_examples_of(spark, sf):
    df = fixture(spark, sf, "doc_holes")
    found = topk_examples(df, example_corpus(df, "row_id"), "row_id")
    return found.withColumn("score", F.round("score", 6))


_T = PromptTemplate(hints=HINTS)
_HINT_TEXT = f"{_T.hint_title}\n- target_group: language of the text\n- intent: rating from 1 to 5"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PROMPTS = f"""{duck_with('doc_holes')}, {_EXAMPLES},
      blocks AS (SELECT e.row_id, string_agg('Example ' || rank || chr(10) || 'Input: ' || {_PAYLOAD_SQL.format(text='CAST(NULL AS VARCHAR)')}
         || chr(10) || 'Output: ' || to_json({{text: text}}), chr(10) || chr(10) ORDER BY rank) AS shown
         FROM examples e JOIN complete c ON c.row_id = e.example_key GROUP BY e.row_id),
      prompts AS (SELECT meta.row_id, {_lit(_T.intro)} || chr(10) || chr(10) || {_lit(_HINT_TEXT)} || chr(10) || chr(10) || shown
         || chr(10) || chr(10) || {_lit(_T.target_title)} || chr(10) || 'Input: ' || {_PAYLOAD_SQL.format(text='CAST(NULL AS VARCHAR)')}
         || chr(10) || {_GUIDANCE} || chr(10) || {_lit(_T.answer_format)} || chr(10) || chr(10) || {_lit(_T.guidelines)} AS prompt,
         {_SEVERITY} AS level
      FROM meta JOIN blocks USING (row_id))"""


@query("build_prompts", f"{_PROMPTS} SELECT * FROM prompts")
def build_prompts_of(spark, sf):
    imputer = PromptImputer(stub_provider, "row_id", template=_T)
    return imputer.prompts(fixture(spark, sf, "doc_holes"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_RAW = _STRIP.format("completion")
_INNER = f"regexp_extract({_RAW}, '(?s)\\{{.*\\}}')"


def _field(json: str) -> str:
    return f"CASE WHEN json_valid({json}) AND json_type({json}, '$.text') = 'VARCHAR' THEN {_STRIP.format(f'json_extract_string({json}, ' + chr(39) + '$.text' + chr(39) + ')')} END"


EXTRACT_SQL = f"""extracted AS (SELECT row_id, conv_id, turn, completion, CASE WHEN completion IS NULL OR completion = '' THEN NULL
    WHEN json_valid({_RAW}) THEN coalesce({_field(_RAW)}, {_RAW})
    ELSE coalesce(CASE WHEN {_INNER} <> '' THEN {_field(_INNER)} END, {_RAW}) END AS answer FROM completions)"""
_VALID = f"""(answer IS NOT NULL AND length({_STRIP.format('answer')}) BETWEEN 10 AND 1200 AND NOT contains(lower(answer), 'unknown')
    AND NOT contains(lower(answer), '无法确定') AND NOT contains(lower(answer), 'not provided')
    AND NOT contains(lower(answer), 'missing information') AND NOT contains(lower(answer), 'cannot infer'))"""


def answers(spark, sf):
    return fixture(spark, sf, "completions").withColumn("answer", extract_completion("completion"))


@query("extract_completion", f"{duck_with('completions')}, {EXTRACT_SQL} SELECT row_id, answer FROM extracted")
def extract_of(spark, sf):
    return answers(spark, sf).select("row_id", "answer")


@query(
    "valid_completion",
    f"{duck_with('completions')}, {EXTRACT_SQL} SELECT row_id, {_VALID} AS is_valid FROM extracted",
)
def valid_of(spark, sf):
    return answers(spark, sf).select("row_id", valid_completion("answer").alias("is_valid"))


def _hits(terms) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in terms) + ")"


@query(
    "lexicon_gate",
    f"""{duck_with('doc_base')} SELECT row_id, CASE {_SEVERITY} WHEN 'high' THEN {_hits(HIGH)} >= 1
        WHEN 'medium' THEN {_hits(HIGH)} + {_hits(MEDIUM)} >= 1 WHEN 'low' THEN {_hits(HIGH)} <= 1
        WHEN 'benign' THEN {_hits(HIGH)} = 0 AND {_hits(MEDIUM)} = 0 ELSE true END AS passes FROM doc_base""",
)
def lexicon_of(spark, sf):
    level = severity_bucket("toxicity_human")
    return fixture(spark, sf, "doc_base").select("row_id", lexicon_gate("text", level, HIGH, MEDIUM).alias("passes"))


@query(
    "exact_dup_gate",
    """SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY lower(text)) AS is_duplicate FROM documents""",
)
def exact_dup_of(spark, sf):
    return exact_dup_gate(table(spark, sf, "documents"), "doc_id").select("doc_id", "is_duplicate")


@query("near_dup_gate")
def near_dup_of(spark, sf):
    return near_dup_gate(table(spark, sf, "documents"), "doc_id")


def stub_provider(requests):
    """A pure stand-in for a text service: the answer depends on row and attempt only."""
    words = ("river", "stone", "amber", "window", "garden", "silver", "letter", "valley", "copper", "meadow")
    out = []
    for row, attempt in zip(requests["row_index"], requests["attempt"]):
        digest = hashlib.md5(f"{row}:{attempt}".encode()).digest()
        text = " ".join(words[b % 10] for b in digest)
        kind = digest[0] % 4
        if kind == 0:
            out.append('{"text": "' + text + '"}')
        elif kind == 1:
            out.append('Sure: {"text": "' + text + '"}')
        elif kind == 2:
            out.append(text)
        else:
            out.append("unknown")
    return out


_STUB_WORDS = "['river', 'stone', 'amber', 'window', 'garden', 'silver', 'letter', 'valley', 'copper', 'meadow']"
_BYTE = "CAST('0x' || substr(digest, 2 * {i} - 1, 2) AS INT)"
_STUB_TEXT = f"array_to_string(list_transform(range(1, 17), lambda i: {_STUB_WORDS}[{_BYTE.format(i='i')} % 10 + 1]), ' ')"
_STUB = f"""{_PROMPTS}, requests AS (SELECT row_id, 1 AS attempt, prompt, md5(row_id || ':1') AS digest FROM prompts),
  answered AS (SELECT row_id, attempt, prompt, CASE {_BYTE.format(i='1')} % 4
      WHEN 0 THEN '{{{{"text": "' || {_STUB_TEXT} || '"}}}}' WHEN 1 THEN 'Sure: {{{{"text": "' || {_STUB_TEXT} || '"}}}}'
      WHEN 2 THEN {_STUB_TEXT} ELSE 'unknown' END AS completion FROM requests)""".replace("{{", "{").replace("}}", "}")


def answered(spark, sf):
    """The built prompts of all rows without a text, answered by the stub."""
    imputer = PromptImputer(stub_provider, "row_id", template=_T)
    prompts = materialize(imputer.prompts(fixture(spark, sf, "doc_holes")), "prompts")
    return complete(prompts, stub_provider, "row_id")


@query("complete_stub", f"{_STUB} SELECT * FROM answered")
def complete_stub(spark, sf):
    return answered(spark, sf)


@query(
    "interaction_log",
    f"""{_STUB} SELECT CAST(row_id AS VARCHAR) AS row_index, attempt, prompt, completion FROM answered
        ORDER BY CAST(row_id AS VARCHAR) LIMIT 5""",
)
def interaction_log(spark, sf):
    path = scratch_path(spark, "log")
    write_log(answered(spark, sf).withColumn("row_index", F.col("row_id").cast("string")), path)
    return read_log(spark, path, 5)


# The first of three attempts whose answer is no refusal; the stub's texts are never alike.
def _stub_fills(source: str, blank: str) -> str:
    return f"""tries AS (SELECT *, md5(row_id || ':' || attempt) AS digest FROM (SELECT *, unnest(range(1, 4)) AS attempt FROM {source} WHERE {blank})),
  firsts AS (SELECT * EXCLUDE (digest), {_STUB_TEXT} AS answer FROM tries WHERE {_BYTE.format(i='1')} % 4 < 3),
  fills AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY mechanism, missing_rate, row_id ORDER BY attempt) = 1)"""


@query(
    "impute_grid_llm",
    f"""{duck_with('doc_base')}, {GRID_SQL}, {_stub_fills("(SELECT * FROM grid WHERE missing_rate = '30')", BLANK)}
        SELECT grid.row_id, grid.mechanism, grid.missing_rate, CASE WHEN {BLANK.replace('text', 'grid.text')} THEN coalesce(answer, grid.text) ELSE grid.text END AS text,
               {BLANK.replace('text', 'grid.text')} AND answer IS NOT NULL AS was_filled
        FROM grid LEFT JOIN fills ON fills.row_id = grid.row_id AND fills.mechanism = grid.mechanism""",
)
def impute_grid_llm(spark, sf):
    """The prompted imputer in the flow of all versions: asked for the largest rate only, carried to the others."""
    versions = grid(spark, sf)  # cheap to make again; written, it is a dozen copies of the texts
    filled = impute_grid(versions, {"llm": PromptImputer(stub_provider, "row_id", template=_T)}, "row_id")
    return filled.select("row_id", "mechanism", "missing_rate", "text", "was_filled")


@query(
    "prompt_impute",
    f"""{duck_with('doc_holes')}, rows_ AS (SELECT *, '' AS mechanism, '' AS missing_rate FROM doc_holes), {_stub_fills('rows_', BLANK)}
        SELECT d.row_id, coalesce(answer, d.text) AS text, answer IS NOT NULL AS was_filled FROM doc_holes d LEFT JOIN fills USING (row_id)""",
)
def prompt_impute(spark, sf):
    imputer = PromptImputer(stub_provider, "row_id", template=_T)
    return imputer.impute(fixture(spark, sf, "doc_holes")).select("row_id", "text", "was_filled")


