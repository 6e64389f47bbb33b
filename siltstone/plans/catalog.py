"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as fn
from siltstone.operators import chunks, graphs, ranking, retrieval

FLAGSHIP = "A2_bm25_top_k"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Tokens and lines, as SQL.
TOKENS = "list_transform(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x))"
LINES = "string_split({}, chr(10))"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(df):
    return df.withColumn("content", F.md5("content"))


def _block_sql(bounds: str, starts: str, blank: str = "len(list_filter(b, lambda x: trim(x, ' ') <> '')) > 0") -> str:
    return f"""with d as (select doc_id, {LINES.format('text')} as l from documents),
    s as (select doc_id, l, unnest({starts}) as i from d),
    r as (select doc_id, l, {bounds} from s),
    c as (select doc_id, lo, hi, l[lo + 1:hi] as b from r)
    select doc_id, cast(lo as int) as start_line, cast(hi - 1 as int) as end_line, md5(array_to_string(b, chr(10))) as content from c where {blank}"""


@query(_block_sql("i as lo, least(len(l), i + 15) as hi", "range(0, len(l), 15)"))
def C1_fixed_blocks(spark, d):
    return _digest(chunks.fixed(table(spark, d, "documents")))


@query(_block_sql("greatest(0, i - 10) as lo, least(len(l), i + 10) as hi", "range(0, len(l), 10)"))
def C2_sliding_blocks(spark, d):
    return _digest(chunks.sliding(table(spark, d, "documents")))


@query(f"""with l as (select doc_id, generate_subscripts({LINES.format('text')}, 1) - 1 as i, unnest({LINES.format('text')}) as x from documents),
n as (select *, row_number() over (partition by doc_id order by i) - 1 as rn from l where trim(x, ' ') <> '')
select doc_id, cast(min(i) as int) as start_line, cast(max(i) as int) as end_line, md5(string_agg(x, chr(10) order by i)) as content
from n where rn < 5000 group by doc_id, rn // 12""")
def C3_filled_blocks(spark, d):
    return _digest(chunks.filled(table(spark, d, "documents")))


@query(f"""with t as (select doc_id, {TOKENS.format('text')} as t from documents),
s as (select doc_id, t, unnest(range(0, greatest(1, len(t) - 20), 1004)) as i from t where len(t) > 0)
select doc_id, cast(i as int) as start_token, md5(array_to_string(t[i + 1:i + 1024], ' ')) as content from s""")
def C10_token_windows(spark, d):
    return _digest(chunks.token_windows(table(spark, d, "documents")))


@query(f"select doc_id, cast(len({TOKENS.format('text')}) as bigint) as n, md5(array_to_string({TOKENS.format('text')}, ' ')) as tokens from documents")
def F1_tokens(spark, d):
    t = fn.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query("select c_custkey, regexp_replace(regexp_replace('own__' || lower(c_mktsegment) || '-' || c_custkey, '-[0-9]+$', ''), '__', '_', 'g') as repo from customer")
def F2_repo_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.repo_of(F.concat(F.lit("own__"), F.lower("c_mktsegment"), F.lit("-"), F.col("c_custkey").cast("string"))).alias("repo"))


@query("select page_id, case when regexp_matches(url, '(?i)com/(.+)$') then regexp_extract(url, '(?i)com/(.+)$', 1) else list_extract(string_split(url, '//'), -1) end as path from pages")
def F3_clean_paths(spark, d):
    return table(spark, d, "pages").select("page_id", fn.clean_path(F.col("url"), "com").alias("path"))


@query("select conv_id, turn, coalesce(nullif(case when role = 'user' then '' else role end, ''), nullif(text, '')) as value from conversations")
def F4_first_filled(spark, d):
    role = F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", fn.first_filled(role, F.col("text")).alias("value"))


@query("select doc_id, substr(sha1(text), 1, 12) as short_sha1, substr(md5(text), 1, 8) as short_md5 from documents")
def F9_F10_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.short_sha1(F.col("text")).alias("short_sha1"), fn.short_md5(F.col("text")).alias("short_md5"))


@query(f"""with t as (select conv_id, turn, list_distinct({TOKENS.format('text')}) as t from conversations),
p as (select conv_id, turn, t, lag(t) over (partition by conv_id order by turn) as u from t)
select conv_id, turn, round(case when len(list_distinct(list_concat(t, u))) = 0 then 1.0 else len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) end, 6) as jaccard from p where u is not null""")
def F11_jaccard(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(fn.tokens(F.col("text"))).alias("t"))
    p = t.withColumn("u", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))).where("u is not null")
    return p.select("conv_id", "turn", F.round(fn.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("select page_id, len(list_filter(regexp_split_to_array(lower(url), '[ _/]'), lambda x: starts_with(x, 'test'))) > 0 as is_test from pages")
def F12_test_paths(spark, d):
    return table(spark, d, "pages").select("page_id", fn.is_test_path(F.col("url")).alias("is_test"))


_MESSAGE = "case event_id % 7 when 0 then 'Context window: length ' || event_id when 1 then 'generate failed ' when 2 then 'read timed out' when 3 then 'HTTP ' || (426 + event_id % 9) when 4 then 'Rate limit' when 5 then 'tokens\nin context' else event_type end"


@query(f"""with m as (select event_id, lower({_MESSAGE.replace(chr(10), "' || chr(10) || '")}) as m from events)
select event_id, case when contains(m, 'context') and (contains(m, 'length') or contains(m, 'token')) or contains(m, 'maximum context') or contains(m, 'max context') then 'CONTEXT_LENGTH_ERROR'
when contains(m, 'timeout') or contains(m, 'timed out') or contains(m, '429') or contains(m, '500') or contains(m, '502') or contains(m, '503') or contains(m, '504') or contains(m, 'rate limit') or contains(m, 'server error') then 'LLM_API_ERROR' else 'SYSTEM_ERROR' end as kind from m""")
def F19_error_kinds(spark, d):
    return table(spark, d, "events").select("event_id", fn.error_kind(F.expr(_MESSAGE.replace("\n", "\\n"))).alias("kind"))


@query("""select doc_id, contains(regexp_replace(text, '[ \\t\\n]', '', 'g'), 'onthe') as held from documents""")
def F21_unspaced_containment(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.holds_unspaced(F.col("text"), F.lit("on the")).alias("held"))


@query("select page_id, array_to_string(regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1), '|') as titles from pages")
def F25_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit("(?s)<title>(.*?)</title>"), 1), "|").alias("titles"))


@query("with t as (select doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from documents) select doc_id, case when length(t) > 80 then substr(t, 1, 77) || '...' else t end as shown from t")
def F26_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.truncated(F.col("text"), 80).alias("shown"))


@query("""with n as (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as norm from embeddings)
select vec_id, round(norm, 6) as norm from n""")
def F29_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(fn.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


def _scored(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))


@query("""with s as (select o_orderpriority as q, o_orderkey as i, o_totalprice as s from orders), w as (select *, min(s) over (partition by q) as lo, max(s) over (partition by q) as hi, avg(s) over (partition by q) as m, stddev_pop(s) over (partition by q) as sd from s)
select 'minmax' as how, q as query_id, i as doc_id, round(case when hi - lo > 1e-8 then (s - lo) / (hi - lo) else 0 end, 6) as score from w
union all select 'zscore', q, i, round(case when sd > 1e-8 then (s - m) / sd else 0 end, 6) from w
union all select 'rank', q, i, round(s, 6) from s
union all select 'sigmoid', q, i, round(1 / (1 + exp(-s)), 6) from s""")
def F30_normalisers(spark, d):
    out = None
    for how in ("minmax", "zscore", "rank", "sigmoid"):
        part = retrieval.normalised(_scored(spark, d), how).select(F.lit(how).alias("how"), "query_id", "doc_id", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


_BM25 = f"""with d as (select doc_id, {TOKENS.format('coalesce(text, \'\')')} as t from documents),
l as (select doc_id, len(t) as dl from d), c as (select count(*) as n, avg(dl) as avgdl from l),
p as (select doc_id, x as term, count(*) as tf from (select doc_id, unnest(t) as x from d) group by all),
f as (select term, count(*) as df, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf from p, c group by term, n),
q as (select item_id, x as term, count(*) as qf from (select item_id, unnest({TOKENS.format('text')}) as x from benchmark) group by all),
s as (select item_id as query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-6)))) as score from q join p using (term) join f using (term) join l using (doc_id), c group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from s)"""


def _bm25(spark, d):
    s = retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return s.withColumn("score", F.round("score", 6))


@query(f"""with d as (select doc_id, {TOKENS.format('coalesce(text, \'\')')} as t from documents), n as (select count(*) as n from d),
f as (select term, count(*) as df from (select distinct doc_id, unnest(t) as term from d) group by term)
select term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from f, n where df >= 2 and df <= 0.5 * n""")
def A1_bm25_terms(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.term_stats(retrieval.postings(docs), docs.count(), 2, 0.5).withColumn("idf", F.round("idf", 6))


@query(_BM25 + " select query_id, doc_id, round(round(score, 6), 4) as score, rank from r where rank <= 10")
def A2_bm25_top_k(spark, d):
    return retrieval.top(_bm25(spark, d), 10).withColumn("score", F.round("score", 4))


@query("select l_returnflag as query_id, l_suppkey as file, round(sum(l_extendedprice), 2) as score from lineitem group by all")
def A3_roll_up_sum(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("query_id"), F.col("l_suppkey").alias("file"), F.col("l_extendedprice").alias("score"))
    return retrieval.roll_up(s, "file").withColumn("score", F.round("score", 2))


@query("select c_mktsegment as query_id, c_nationkey as file, greatest(max(c_acctbal), 0) as score from customer group by all")
def A4_roll_up_max(spark, d):
    s = table(spark, d, "customer").select(F.col("c_mktsegment").alias("query_id"), F.col("c_nationkey").alias("file"), F.col("c_acctbal").alias("score"))
    return retrieval.roll_up(s, "file", "max")


@query("""with s as (select c_mktsegment as query_id, c_nationkey as file, c_acctbal as score, row_number() over (partition by c_mktsegment, c_nationkey order by c_acctbal desc, c_custkey) as n from customer)
select query_id, file, round(sum(score * power(0.5, n - 1)), 6) as score from s where n <= 5 group by all""")
def A5_decayed_alignment(spark, d):
    s = table(spark, d, "customer").select(F.col("c_mktsegment").alias("query_id"), F.col("c_nationkey").alias("file"), F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("score"))
    return retrieval.decayed(s, "file").withColumn("score", F.round("score", 6))


def _graph(spark, d):
    """Customers point at nations, nations at regions."""
    nation = table(spark, d, "nation")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("invokes").alias("type"))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("contains").alias("type"))
    edges = c.unionByName(n)
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges


_EDGES = """e as (select 'c' || c_custkey as src, 'n' || c_nationkey as dst, 'invokes' as type from customer union all select 'n' || n_nationkey, 'r' || n_regionkey, 'contains' from nation)"""
_GRAPH = f"{_EDGES}, v as (select distinct id from (select src as id from e union all select dst from e))"


@query(f"with {_GRAPH} select v.id, count(e.src) as in_degree from v left join e on e.dst = v.id and e.type = 'invokes' group by v.id")
def A7_in_degree(spark, d):
    return graphs.in_degree(*_graph(spark, d))


def _rank_sql(rounds: int) -> str:
    out = f"with {_EDGES}, l as (select distinct src, dst from e where type = 'invokes'), v as (select src as id from l union select dst from l), o as (select src, count(*) as deg from l group by src), k as (select count(*) as n from v), r0 as (select id, 1.0 / n as rank, n from v, k)"
    for i in range(1, rounds + 1):
        out += f""", g{i} as (select l.dst as id, sum(r.rank / o.deg) as got from l join o using (src) join r{i - 1} r on r.id = l.src group by l.dst),
        x{i} as (select coalesce(sum(rank), 0) as loose from r{i - 1} where id not in (select src from o)),
        r{i} as (select r.id, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) as rank, n from r{i - 1} r left join g{i} using (id), x{i})"""
    return out + f" select id, round(rank, 9) as rank from r{rounds}"


@query(_rank_sql(3))
def A8_pagerank(spark, d):
    return graphs.pagerank(_graph(spark, d)[1], rounds=3, tolerance=0).withColumn("rank", F.round("rank", 9))


@query("""select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, count(distinct user_id) as users from events group by event_type""")
def A11_metric_roll_up(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users"))


@query("select lower(p_brand) as name, array_to_string(list_sort(list(p_partkey)), ',') as ids from part group by 1")
def A13_names(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_brand").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("p_partkey")), ",").alias("ids"))


@query("""with s as (select a.vec_id as query_id, b.vec_id as doc_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: cast(z[1] as double) * z[2])) as score from embeddings a, embeddings b where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from s)
select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 10""")
def R2_dense_top_k(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.top(retrieval.dense(v, v.where("vec_id % 50 = 0")).withColumn("score", F.round("score", 6)), 10)


def _two(spark, d):
    """Two rankings of the suppliers of a nation."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("doc_id"), "s_acctbal")
    return s.select("query_id", "doc_id", F.col("s_acctbal").alias("score")), s.select("query_id", "doc_id", (F.col("doc_id") % 17).cast("double").alias("score"))


_TWO = "a as (select s_nationkey as q, s_suppkey as i, s_acctbal as s from supplier), b as (select s_nationkey as q, s_suppkey as i, cast(s_suppkey % 17 as double) as s from supplier)"


@query(f"""with {_TWO}, r as (select q, i, row_number() over (partition by q order by s desc, i) as k from a union all select q, i, row_number() over (partition by q order by s desc, i) from b)
select q as query_id, i as doc_id, round(sum(1.0 / (60 + k)), 9) as score from r where k <= 50 group by all""")
def R4_rrf(spark, d):
    a, b = _two(spark, d)
    return retrieval.rrf(retrieval.top(a, 50), retrieval.top(b, 50)).withColumn("score", F.round("score", 9))


@query(f"""with {_TWO} select q as query_id, i as doc_id, round(sum(w), 6) as score from (select q, i, 0.3 * s as w from a union all select q, i, 0.7 * s from b) group by all""")
def R5_weighted(spark, d):
    a, b = _two(spark, d)
    return retrieval.weighted((a, 0.3), (b, 0.7)).withColumn("score", F.round("score", 6))


_RANKED = "s as (select o_orderpriority as q, o_orderkey as i, o_custkey as f, o_totalprice as s, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders)"


def _ranked(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("file"), F.col("o_totalprice").alias("score"))
    return o


@query(f"""with {_RANKED}, c as (select *, row_number() over (partition by q, f order by r) as n from s), p as (select *, row_number() over (partition by q order by r) as place from c where n <= 2)
select q as query_id, i as doc_id, f as file, place from p where place <= 100""")
def R7_feedback_selection(spark, d):
    ranked = _ranked(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return retrieval.capped(ranked, "file", 2, 100).select("query_id", "doc_id", "file", "place")


@query(f"""with {_RANKED}, a as (select q, f, min(r) as r from s where r <= 100 group by all), z as (select q, f, row_number() over (partition by q order by r) as k from a),
n as (select s.q, s.i, s.f, row_number() over (partition by s.q order by s.s desc, s.i) as rank from s where exists (select 1 from z where z.q = s.q and z.f = s.f and z.k <= 8)),
h as (select q as query_id, i as doc_id, rank, 0 as pad from n where rank <= 20), k as (select query_id, count(*) as n from h group by 1),
w as (select x.query_id, case when coalesce(k.n, 0) < 5 then 'fallback_stage1' when k.n >= 20 then 'stage2' else 'stage2+pad' end as reason from (select distinct q as query_id from s) x left join k using (query_id)),
b as (select h.*, reason from h join w using (query_id) where reason <> 'fallback_stage1' union all select s.q, s.i, s.r, 1, reason from s join w on w.query_id = s.q where s.r <= 20 and (reason = 'fallback_stage1' or not exists (select 1 from h where h.query_id = s.q and h.doc_id = s.i)))
select query_id, doc_id, reason, place from (select *, row_number() over (partition by query_id order by pad, rank) as place from b) where place <= 20""")
def P4_two_stage(spark, d):
    first = retrieval.top(_ranked(spark, d), 100)
    return ranking.accepted(first, retrieval.two_stage(_ranked(spark, d), "file", 100, 20, 8), 20)


@query("""with b as (select l_suppkey as file, l_orderkey as b_id, l_linenumber as b_line, l_orderkey % 5000 as b_start, l_orderkey % 5000 + cast(l_quantity as bigint) as b_end from lineitem),
s as (select s_suppkey as file, s_nationkey * 100 as s_start, s_nationkey * 100 + 400 as s_end from supplier)
select file, b_id, b_start, b_end, s_start, s_end from b join s using (file) where b_start <= s_end and b_end >= s_start""")
def J4_interval_overlap(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("b_id"), (F.col("l_orderkey") % 5000).alias("b_start"), (F.col("l_orderkey") % 5000 + F.col("l_quantity").cast("long")).alias("b_end"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_nationkey") * 100).cast("long").alias("s_start"), (F.col("s_nationkey") * 100 + 400).cast("long").alias("s_end"))
    return graphs.overlapping(b, s, 200)


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)")
def J7_restricted(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def J12_not_processed(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"with {_GRAPH} select dst as id, src as neighbour, type from e where type = 'contains' and dst in ('r0', 'r1')")
def G5_neighbours(spark, d):
    _, edges = _graph(spark, d)
    of = spark.createDataFrame([("r0",), ("r1",)], "id string")
    return graphs.neighbours(edges, of, "backward", ["contains"])


@query(f"""with recursive {_GRAPH}, w as (select id, 0 as depth from v where id in ('c1', 'c2', 'c3') union select e.dst, w.depth + 1 from w join e on e.src = w.id where w.depth < 3)
select id, min(depth) as depth from w group by id""")
def G6_reach(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.reach(edges, nodes.where("id in ('c1', 'c2', 'c3')"), 3)


@query("select user_id, event_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def K6_latest_wins(spark, d):
    return graphs.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "ts")


@query("select sha1(string_agg(url, chr(10) order by url)) as digest, count(*) as n from pages")
def K9_input_snapshot(spark, d):
    return table(spark, d, "pages").agg(F.sha1(F.array_join(F.sort_array(F.collect_list("url")), "\n")).alias("digest"), F.count("*").alias("n"))


@query("select event_id, ts from events where ts > timestamp '2024-01-15 00:00:00'")
def S10_updated_since(spark, d):
    return table(spark, d, "events").where(F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id", "ts")


@query("""select doc_id, lang || ' ' || source as text, case when n_chars < 200 then source else lang || chr(10) || source end as embed_text from documents""")
def D5_embedding_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "lang", "source").alias("text"), F.when(F.col("n_chars") < 200, F.col("source")).otherwise(F.concat_ws("\n", "lang", "source")).alias("embed_text"))
