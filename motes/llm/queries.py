"""The registered queries of this subpackage: ``name -> (function, SQL or None)``."""

from __future__ import annotations

from pyspark.sql import functions as F

from motes.llm import (contained, dual_tree, frames, hnsw, line_blocks, minhash, packing, periodic, personal, run_index, simhash,
                       toxicity, words_bpe)

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn
    return add


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query()
def op2_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"))


@query()
def op8_token_frames(spark, sf_dir):
    return frames.round_trip(read(spark, sf_dir, "documents"))


@query()
def op7_line_blocks(spark, sf_dir):
    return line_blocks.extract(read(spark, sf_dir, "pages"))


@query()
def op9_word_bpe(spark, sf_dir):
    return words_bpe.round_trip(read(spark, sf_dir, "documents"))


@query()
def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=4)


@query()
def op3_run_index(spark, sf_dir):
    return run_index.without_repeats(read(spark, sf_dir, "documents"))


@query()
def op1_simhash(spark, sf_dir):
    return simhash.compared(read(spark, sf_dir, "documents"))


@query()
def op5_personal(spark, sf_dir):
    return personal.personal_data(read(spark, sf_dir, "documents"))


@query()
def op6_toxicity(spark, sf_dir):
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op10_hnsw(spark, sf_dir):
    return hnsw.nearest(read(spark, sf_dir, "embeddings"))


def _lloyd_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The same codes by comparing every part with every entry."""
    gap = "list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT"

    def near(book: str) -> str:
        return f"select p.id, p.p, min(({gap}) * {entries} + c.e) as best from part p join {book} c on p.p = c.p group by p.id, p.p"
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} as ({near(f'book{k}')})")
        steps.append(f"""mean{k} as (select p, e, list(m order by i) as x from (
            select p.p, n.best % {entries} as e, u.i, floor(sum(p.x[u.i])::DOUBLE / count(*))::BIGINT as m
            from near{k} n join part p on p.id = n.id and p.p = n.p, (select unnest(range(1, len(x) + 1)) as i from (select x from part limit 1)) u
            group by p.p, e, u.i) group by p, e)""")
        steps.append(f"book{k + 1} as (select b.p, b.e, coalesce(m.x, b.x) as x from book{k} b left join mean{k} m on m.p = b.p and m.e = b.e)")
    return f"""with kept as (
      select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) as v,
             row_number() over (order by vec_id) - 1 as id
      from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    part as (select id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] as x from kept, (select unnest(range({parts})) as p)),
    book0 as (select p, id as e, x from part where id < {entries}),
    {", ".join(steps)},
    final as ({near(f"book{rounds}")}),
    coded as (select k.vec_id, k.label, string_agg(printf('%02x', best % {entries}), '' order by f.p) as code, sum(best // {entries})::BIGINT as error
              from final f join kept k using (id) group by k.id, k.vec_id, k.label),
    books as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
    select vec_id, code, error, sum(error) over (partition by label)::BIGINT as label_error, codebooks_sha256 from coded, books"""


@query(_lloyd_sql())
def op11_dual_tree(spark, sf_dir):
    return dual_tree.digests(*dual_tree.compressed(read(spark, sf_dir, "embeddings")))


@query()
def op12_periodic(spark, sf_dir):
    return periodic.digests(periodic.periodic_runs(periodic.with_planted_runs(read(spark, sf_dir, "documents"))))


@query(r"""with word as (
      select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    item as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[s:s + 9], ' ') as win
            from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from item where len(w) > 0)),
    size as (select distinct n from win),
    place as (select r, s, n, array_to_string(w[s:s + n - 1], ' ') as win
              from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from word, size where len(w) >= n)),
    hit as (select distinct p.r, p.s, p.n, win.item_id from place p join win on win.win = p.win and win.n = p.n),
    covered as (select r, count(*) as n_hit from (select distinct r, unnest(range(s, s + n)) as i from hit) group by r),
    found as (select r, count(*) as n_items, sha256(string_agg(item_id::VARCHAR, ',' order by item_id::VARCHAR)) as items_sha256
              from (select distinct r, item_id from hit) group by r)
    select doc_id, len(w)::BIGINT as n_words, coalesce(n_hit, 0)::BIGINT as n_hit, coalesce(n_items, 0)::BIGINT as n_items,
           coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from word left join covered using (r) left join found using (r)""")
def op13_contained(spark, sf_dir):
    return contained.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
