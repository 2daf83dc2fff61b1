"""The named queries of the operators: thin calls over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import additive_model, conversation_trie, license_scan, packing, periodic_runs, repeated_bytes, repeated_passages, secret_grammar, simhash_bktree, string_tiling, suffix_tree, token_files, weak_supervision
from .frames import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_simhash_bktree(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_bktree.near_duplicates(table(spark, folder, "documents"))


@query
def op2_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    return weak_supervision.judge(table(spark, folder, "documents"))


@query
def op8_additive_model(spark: SparkSession, folder: str) -> DataFrame:
    return additive_model.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_secret_grammar(spark: SparkSession, folder: str) -> DataFrame:
    return secret_grammar.report(table(spark, folder, "documents"))


@query
def op1_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return string_tiling.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op10_config_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_wavelet_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path, with_ids=False)


@query
def op6_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, folder, "documents"))


@query
def op9_bucket_refinement(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query
def op5_conditional_compression(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, folder, "documents"), edit=periodic_runs.planted, with_text=False)


@query
def op11_fm_index(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages.remove_passages(table(spark, folder, "documents")).drop("kept")


ORACLE["op11_fm_index"] = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from texts),
windows as (
  select doc_id, i, word, count(*) over s as n, string_agg(word, ' ') over s as t from words
  window s as (partition by doc_id order by i rows between current row and 49 following)),
earliest as (select t, min(doc_id) as first_doc from windows where n = 50 group by t),
marked as (
  select a.doc_id, a.i, a.word, case when a.n = 50 and b.first_doc < a.doc_id then 1 else 0 end as repeats
  from windows a left join earliest b on a.n = 50 and b.t = a.t),
covered as (
  select doc_id, i, word, max(repeats) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from marked),
spans as (select *, lag(gone, 1, 0) over (partition by doc_id order by i) as before from covered),
sums as (
  select doc_id, count(*) as n_words, sum(gone) as n_removed, sum(case when gone = 1 and before = 0 then 1 else 0 end) as n_spans,
    string_agg(word, ' ' order by i) filter (where gone = 0) as kept from spans group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(coalesce(kept, '')) as kept_sha256 from documents d left join sums s on s.doc_id = d.doc_id
"""

@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    convs = table(spark, folder, "conversations")
    turns = conversation_trie.with_shared_heads(conversation_trie.turns_of(convs))
    return conversation_trie.prefix_trie(turns, conversation_trie.shards_for(convs))


# The checksum takes each byte, then eight halvings; 3988292384 is its polynomial.
ORACLE["op12_prefix_trie"] = r"""
with turns as (
  select conv_id c, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
    order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
  from conversations where conv_id is not null group by conv_id),
steps as (
  select c, own, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''),
      lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as s from turns),
heads as (select c, own, (xor(s, 4294967295) % 4)::int as h from steps),
rebuilt as (
  select a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) as path
  from heads a left join heads b on b.c = a.c - a.c % 20),
prefixes as (select c, len(path) as n, unnest(range(0, len(path) + 1)) as d, path from rebuilt),
members as (select c, n, d, path[1:d] as p, path from prefixes),
nodes as (
  select p, d, min(c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where n = d), '')) as ends_sha256
  from members group by p, d),
weights as (
  select *, case when d = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) end as saved from nodes),
kids as (select p[1:d - 1] as up, d - 1 as ud, count(*) as n_children from nodes where d > 0 group by all),
full_nodes as (select w.*, coalesce(k.n_children, 0) as n_children from weights w left join kids k on k.up = w.p and k.ud = w.d),
above as (select unnest(range(0, d + 1)) as ad, p, saved, n_children from full_nodes),
below as (
  select p[1:ad] as p, ad, sum(saved) as saved_tokens, sum(case when n_children = 0 then 1 else 0 end) as n_leaves from above group by all)
select f.conv_id::bigint as conv_id, f.d::bigint as depth, u.conv_id::bigint as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
  b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, f.ends_sha256
from full_nodes f join below b on b.p = f.p and b.ad = f.d left join nodes u on f.d > 0 and u.p = f.p[1:f.d - 1] and u.d = f.d - 1
"""
