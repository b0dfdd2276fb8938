"""The registered queries of the corpus operators: ``opN_<name>``, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, license, lm, pii, quality, secrets, simhash, substring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents")).drop("digest")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_units", "n_matches", "licenses", "best")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_substring, op3_langid, op4_pii, op5_license, op6_quality, op7_lm, op8_simhash, op9_bpe, op10_secrets)}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""with b as (select item_id, {_ITEM_WORDS} w from benchmark),
  win as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') win from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
  d as (select row_number() over () rid, doc_id, {_ITEM_WORDS} w from documents),
  p as (select rid, n, w, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win) where len(w) >= n),
  h as (select rid, i, p.n, item_id from (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') s from p) p join win on s = win and p.n = win.n),
  c as (select rid, count(distinct k)::bigint n_hit from (select rid, unnest(range(i, i + n)) k from h) group by 1),
  m as (select rid, list_sort(list_distinct(list(item_id::varchar))) ids from h group by 1)
  select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(len(ids), 0)::bigint n_items, sha256(coalesce(array_to_string(ids, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
  from d left join c using (rid) left join m using (rid)"""


_BLANK = r"[\x20\x09-\x0D]+"
_TRIMMED = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP6_SQL = rf"""with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
  w as (select *, [x for x in regexp_split_to_array(t, '{_BLANK}') if x <> ''] w, [x for x in string_split(t, chr(10)) if {_TRIMMED.format('x')} <> ''] lines from d),
  g as (select rid, i, count(*) over (partition by rid, a) n from (select rid, i, w[i:i + 2] a from (select rid, w, unnest(range(1, len(w) - 1)) i from w where len(w) > 2))),
  r as (select rid, count(distinct k)::bigint n from (select rid, unnest(range(i, i + 3)) k from g where n > 1) group by 1),
  base as (select w.rid, doc_id, source, len(w)::bigint n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words from w left join r on w.rid = r.rid),
  l as (select rid, source, {_TRIMMED.format('line')} line from (select rid, source, unnest(lines) line from w)),
  n as (select rid, source, regexp_split_to_array(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{_BLANK}') line from l),
  f as (select n.source, line, count(distinct copy) docs from n join (select rid, md5(t) as copy from d) c on n.rid = c.rid group by 1, 2),
  o as (select f.source, line from f join (select source, count(*) total from documents group by 1) h on f.source is not distinct from h.source where docs > 20 and docs > total * 0.02::double),
  k as (select rid, sum(len(n.line)) lost from n join o on n.source is not distinct from o.source and n.line = o.line group by 1)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or n_repeat_words * 100 > n_words * 50 base_failed,
    not (n_words < 50 or n_repeat_words * 100 > n_words * 50) and n_words - coalesce(lost, 0) >= n_words * 0.3::double kept from base left join k on base.rid = k.rid"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op6_quality": OP6_SQL}
