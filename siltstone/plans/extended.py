"""More queries of the catalog: selections, roll-ups, joins by condition, names and text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as fn
from siltstone.operators import chunks, ranking, retrieval
from siltstone.plans.catalog import TOKENS, query, table


def _ranked(spark, d):
    """Orders of a customer's priority, ranked by price; the file is the customer."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("file"), F.col("o_totalprice").alias("score"))
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


_RANKED = "s as (select o_orderpriority as query_id, o_orderkey as doc_id, o_custkey as file, o_totalprice as score, cast(row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as int) as rank from orders)"


@query(f"with {_RANKED}, f as (select query_id, file, min(rank) as first_rank from s group by all), p as (select *, row_number() over (partition by query_id order by first_rank) as place from f) select * from p where place <= 8")
def R8_seed_files(spark, d):
    return ranking.seeds(_ranked(spark, d), "file", 8)


@query(f"""with {_RANKED}, c as (select * from s where rank % 7 = 1 and rank <= 30), b as (select query_id, doc_id, rank, 0 as pad from c union all select query_id, doc_id, rank, 1 from s where (query_id, doc_id) not in (select (query_id, doc_id) from c)),
p as (select query_id, doc_id, row_number() over (partition by query_id order by pad, rank) as place, pad from b) select * from p where place <= 20""")
def J8_padding(spark, d):
    r = _ranked(spark, d)
    return ranking.padded(r.where("rank % 7 = 1 and rank <= 30"), r, 20)


@query(f"with {_RANKED}, t as (select query_id, doc_id, rank, score, min(case when rank <= 10 then score end) over (partition by query_id) as low from s where rank <= 50) select query_id, doc_id, rank, round(case when rank <= 10 then score else low - (rank - 10) * 0.000001 end, 6) as score from t")
def R11_tail_scores(spark, d):
    return ranking.tail_lowered(_ranked(spark, d).where("rank <= 50"), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"with {_RANKED}, t as (select * from s where rank <= 500) select query_id, doc_id, rank from t where file % 3 = 0")
def J11_filter_after_limit(spark, d):
    return _ranked(spark, d).where("rank <= 500").where("file % 3 = 0").select("query_id", "doc_id", "rank")


@query("""with h as (select s_nationkey as query_id, s_suppkey as doc_id, greatest(s_acctbal, 1) as score from supplier),
f as (select n_nationkey as query_id, s_suppkey as doc_id, 0.0 as score from nation, supplier where (n_nationkey, s_suppkey) not in (select (query_id, doc_id) from h)),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select * from h union all select * from f)) select query_id, doc_id, cast(score as double) as score, rank from r where rank <= 10""")
def R1_zero_filled_top_k(spark, d):
    s = table(spark, d, "supplier")
    hits = s.select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("doc_id"), F.greatest("s_acctbal", F.lit(1.0)).alias("score"))
    queries = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"))
    return ranking.zero_filled(hits, queries, s.select(F.col("s_suppkey").alias("doc_id")), 10)


_SOURCES = "select c_nationkey as file, 0 as source, round(c_acctbal / 1000) as score from customer union all select s_nationkey, 1, round(s_acctbal / 1000) from supplier"


def _sources(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("file"), F.lit(0).alias("source"), F.round(F.col("c_acctbal") / 1000).alias("score"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), F.lit(1).alias("source"), F.round(F.col("s_acctbal") / 1000).alias("score")))


@query(f"with s as ({_SOURCES}), r as (select *, row_number() over (partition by file order by score desc, source) as n from s) select file, source, score from r where n = 1")
def A6_best_provenance(spark, d):
    return ranking.best_source(_sources(spark, d), ["file"])


@query(f"""with s as ({_SOURCES}), n as (select file, source, sum(score) as score from s group by all), w as (select *, min(score) over (partition by source) as lo, max(score) over (partition by source) as hi from n)
select file, round(sum((case when source = 0 then 0.6 else 0.4 end) * case when hi - lo > 1e-8 then (score - lo) / (hi - lo) else 0 end), 6) as score from w group by file""")
def P7_fused_sources(spark, d):
    files = _sources(spark, d).groupBy("source", "file").agg(F.sum("score").alias("score"))
    parts = [(retrieval.normalised(files.where(F.col("source") == i).select(F.lit(0).alias("query_id"), F.col("file").alias("doc_id"), "score"), "minmax"), w) for i, w in ((0, 0.6), (1, 0.4))]
    return retrieval.weighted(*parts).select(F.col("doc_id").alias("file"), F.round("score", 6).alias("score"))


@query("""with b as (select l_returnflag as query_id, l_suppkey as file, l_linenumber as source, nullif(cast(l_quantity as int), 7) as start_line, cast(l_quantity as int) + 5 as end_line, l_orderkey as rank from lineitem),
k as (select *, row_number() over (partition by query_id, source order by rank, file, start_line nulls last, end_line nulls last) as n from b),
r as (select *, row_number() over (partition by query_id, file, start_line, end_line order by source, rank) as m from k where n <= 200 and start_line is not null) select query_id, file, start_line, end_line, source, rank from r where m = 1""")
def P8_mapping_blocks(spark, d):
    q = F.col("l_quantity").cast("int")
    b = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("query_id"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("source"), F.nullif(q, F.lit(7)).alias("start_line"), (q + 5).alias("end_line"), F.col("l_orderkey").alias("rank"))
    return ranking.mapping_blocks(b, 200)


@query("""with s as (select item_id % 4 as query_id, item_id as doc_id, cast(row_number() over (partition by item_id % 4 order by item_id) - 1 as int) as rank, cast(length(text) as bigint) as tokens from benchmark),
a as (select *, sum(tokens) over (partition by query_id) as t, sum(least(tokens, 50)) over (partition by query_id order by rank) as need from s),
k as (select * from a where t < 400 or need <= 400), w as (select *, 400 - max(need) over (partition by query_id) as lft, power(1.05, -rank) as w from k)
select query_id, doc_id, rank, tokens, cast(case when t < 400 then tokens else least(tokens, 50 + floor(lft * w / sum(w) over (partition by query_id))) end as bigint) as given from w""")
def R10_token_budget(spark, d):
    order = Window.partitionBy("query_id").orderBy("doc_id")
    b = table(spark, d, "benchmark").select((F.col("item_id") % 4).alias("query_id"), F.col("item_id").alias("doc_id"), F.length("text").cast("long").alias("tokens"))
    return ranking.budgeted(b.withColumn("rank", F.row_number().over(order) - 1), 400)


@query("""with q as (select a.vec_id as query_id, a.embedding as q0, b.embedding as q1 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 50 = 0),
a as (select query_id, vec_id, list_sum(list_transform(list_zip(q0, embedding), lambda z: cast(z[1] as double) * z[2])) as score, embedding from q, embeddings),
f as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from a) where r <= 8),
w as (select *, exp((score - max(score) over (partition by query_id)) / 0.05) as w from f),
e as (select query_id, w, unnest(range(0, len(embedding))) as i, unnest(embedding) as x from w), c0 as (select query_id, i, sum(w * cast(x as double)) / sum(w) as c from e group by all), c as (select query_id, i, c / sqrt(sum(c * c) over (partition by query_id)) as c from c0),
o as (select query_id, unnest(range(0, len(q0))) as i, unnest(q0) as q, unnest(q1) as p from q), n as (select query_id, i, 0.5 * cast(q as double) + 0.35 * c + 0.15 * cast(p as double) as x from o join c using (query_id, i))
select query_id, cast(i as int) as i, round(x / sqrt(sum(x * x) over (partition by query_id)), 6) as x from n""")
def P2_moved_query(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q0"))
    other = v.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("q"))
    best = retrieval.top(retrieval.dense(v, v.where("vec_id % 50 = 0")), 8)  # the feedback
    f = best.join(v.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("query_id", "score", "embedding")
    return ranking.moved_query(f, q.join(other, "query_id")).withColumn("x", F.round("x", 6))


@query("""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id as doc_id, round(list_sum(list_transform(list_zip(q, embedding), lambda z: (cast(z[1] as double) - z[2]) * (cast(z[1] as double) - z[2]))), 6) as distance from q, embeddings where label <> 0),
r as (select *, row_number() over (partition by query_id order by distance, doc_id) as rank from s) select * from r where rank <= 10""")
def D8_l2_top_k(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    gap = F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda x, y: x + y)
    s = v.where("label <> 0").crossJoin(F.broadcast(q)).select("query_id", F.col("vec_id").alias("doc_id"), F.round(gap, 6).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return s.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


@query("""select doc_id, case when quality is null then 'generate' when quality = 1 and toxic = 0 then 'reuse' else 'refresh' end as action from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id)""")
def J9_reuse_decision(spark, d):
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    action = F.when(F.col("quality").isNull(), "generate").when(F.expr("quality = 1 and toxic = 0"), "reuse").otherwise("refresh")
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", action.alias("action"))


@query("select l.doc_id, l.quality, d.source from labels l join documents d using (doc_id)")
def J3_hits_to_documents(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query("""with n as (select n_regionkey, n_name || ': ' || string_agg(s_name, ', ' order by s_name) as t, n_name from supplier join nation on s_nationkey = n_nationkey group by n_regionkey, n_name)
select r_name, md5(string_agg(t, chr(10) order by n_name)) as summary, count(*) as parts from n join region on n_regionkey = r_regionkey group by r_name""")
def A9_hierarchical_roll_up(spark, d):
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    inner = joined.groupBy("n_regionkey", "n_name").agg(F.array_join(F.sort_array(F.collect_list("s_name")), ", ").alias("t"))
    outer = inner.join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).groupBy("r_name")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n_name", "t"))), lambda x: F.concat(x["n_name"], F.lit(": "), x["t"]))
    return outer.agg(F.md5(F.array_join(lines, "\n")).alias("summary"), F.count("*").alias("parts"))


@query("select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'F') as done, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as rate, round(avg(o_totalprice), 4) as mean from orders group by 1")
def A10_run_statistics(spark, d):
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.round(F.avg(done.cast("double")), 6).alias("rate"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(f"with t as (select source, cast(sum(len({TOKENS.format('text')})) as bigint) as tokens from documents group by source) select source, tokens, round(tokens / sum(tokens) over (), 9) as share from t")
def A12_token_totals(spark, d):
    t = table(spark, d, "documents").groupBy("source").agg(F.sum(F.size(fn.tokens(F.col("text")))).alias("tokens"))
    return t.select("source", "tokens", F.round(F.col("tokens") / t.agg(F.sum("tokens").alias("x")).scalar(), 9).alias("share"))


@query("""with c as (select n_regionkey as module, c_custkey as id, n_nationkey as importance, c_name like '%1' as is_test from customer join nation on c_nationkey = n_nationkey),
r as (select *, row_number() over (order by module = 1 desc, importance desc, not is_test desc, id desc) as rank from c) select id, rank from r where rank <= 25""")
def R6_caller_ranking(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    keys = [F.expr("n_regionkey = 1").alias("a"), F.col("n_nationkey").alias("b"), (~F.col("c_name").like("%1")).alias("c"), F.col("c_custkey").alias("id")]
    best = c.select(*keys).distinct().orderBy(*[F.desc(k) for k in ("a", "b", "c", "id")]).limit(25)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("a"), F.desc("b"), F.desc("c"), F.desc("id")))).select("id", "rank")  # 25 rows


@query("select distinct s_nationkey as file, unnest(range(s_suppkey % 9, s_suppkey % 9 + 4)) as line from supplier")
def M4_relevant_lines(spark, d):
    lo = F.col("s_suppkey") % 9
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), F.explode(F.sequence(lo, lo + 3)).alias("line")).distinct()


@query("select r_name || '/' || n_name || '/' || s_name as path, 3 as depth from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey union all select r_name || '/' || n_name, 2 from nation join region on n_regionkey = r_regionkey union all select r_name, 1 from region")
def G11_tree_paths(spark, d):
    r = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("path"))
    n = table(spark, d, "nation").join(r, F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.concat_ws("/", "path", "n_name").alias("path"))
    s = table(spark, d, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).select(F.concat_ws("/", "path", "s_name").alias("path"))
    return s.withColumn("depth", F.lit(3)).unionByName(n.select("path", F.lit(2).alias("depth"))).unionByName(r.select("path", F.lit(1).alias("depth")))


@query("select n_regionkey as file, cast(to_json(list({'name': n_name, 'id': n_nationkey} order by n_name)) as varchar) as tree from nation group by 1")
def K5_hierarchical_json(spark, d):
    rows = F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))))
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("file")).agg(F.to_json(rows).alias("tree"))


@query(f"select doc_id, md5(array_to_string({TOKENS.format('text')}[1:5], ' ')) as head, cast(len(list_distinct({TOKENS.format('text')})[1:20]) as int) as kinds from documents")
def F5_capped_lists(spark, d):
    t = fn.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.slice(t, 1, 5), " ")).alias("head"), F.size(F.slice(F.array_distinct(t), 1, 20)).alias("kinds"))


@query("select conv_id, 'called_by=' || string_agg(distinct role, '|' order by role) || chr(10) || 'calls=' || count(*) as context from conversations group by conv_id")
def F8_context_form(spark, d):
    who = F.array_join(F.array_sort(F.collect_set("role")), "|")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("called_by="), who, F.lit("\ncalls="), F.count("*").cast("string")).alias("context"))


@query("select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) < 3 or regexp_matches(source, '^(get|set|web)') as is_placeholder from documents")
def F14_placeholders(spark, d):
    filled = F.size(F.filter(fn.lines(F.col("text")), lambda x: F.trim(x) != ""))
    return table(spark, d, "documents").select("doc_id", ((filled < 3) | F.col("source").rlike("^(get|set|web)")).alias("is_placeholder"))


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[.]html?$', ''), '/', '.', 'g') as module from pages")
def F15_module_paths(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[.]html?$", "")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(path, "/", ".").alias("module"))


@query("select p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ', ' || p_type || ';' || p_brand, '[,;\\n]'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') as keywords from part")
def F17_keywords(spark, d):
    parts = F.split(F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit(";"), F.col("p_brand")), "[,;\n]")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "|").alias("keywords"))


@query("select event_id, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) as prompt, coalesce(cast(json_extract_string(props, '$.missing') as bigint), 0) as completion, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) + coalesce(cast(json_extract_string(props, '$.missing') as bigint), 0) as total from events")
def F18_usage(spark, d):
    p, c = (F.coalesce(F.get_json_object("props", f"$.{k}").cast("long"), F.lit(0)) for k in ("k", "missing"))
    return table(spark, d, "events").select("event_id", p.alias("prompt"), c.alias("completion"), (p + c).alias("total"))


@query("select item_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: cast(i as varchar) || ' | ' || x), chr(10))) as snippet from benchmark")
def F24_numbered_snippet(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(ranking.numbered(F.col("text"))).alias("snippet"))


@query("select doc_id, md5('File: ' || source || chr(10) || 'Lines: ' || n_chars || '-' || chr(10) || chr(10) || 'Code:' || chr(10) || text) as wrapped from documents where text is not null")
def C15_context_wrapper(spark, d):
    head = [F.lit("File: "), F.col("source"), F.lit("\nLines: "), F.col("n_chars").cast("string"), F.lit("-\n\nCode:\n"), F.col("text")]
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.concat(*head)).alias("wrapped"))


@query(f"""with t as (select doc_id, {TOKENS.format('text')} as t from documents), s as (select doc_id, t, unnest(range(0, greatest(1, len(t) - 200), 800)) as i from t where len(t) > 0)
select doc_id, cast(i as int) as start_token, md5(array_to_string(t[i + 1:i + 1000], ' ')) as content from s""")
def C14_token_windows_overlapping(spark, d):
    return chunks.token_windows(table(spark, d, "documents"), 1000, 200).withColumn("content", F.md5("content"))


@query("""with n as (select label, vec_id, embedding, lag(embedding) over (partition by label order by vec_id) as prev from embeddings), g as (select label, vec_id, round(1 - list_sum(list_transform(list_zip(prev, embedding), lambda z: cast(z[1] as double) * z[2])), 6) as gap from n where prev is not null),
c as (select label, quantile_cont(gap, 0.95) as cut from g group by label) select label, vec_id, gap from g join c using (label) where gap > cut""")
def C11_semantic_breaks(spark, d):
    n = table(spark, d, "embeddings").withColumn("prev", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("prev is not null")
    g = n.select("label", "vec_id", F.round(1 - fn.dot(F.col("prev"), F.col("embedding")), 6).alias("gap"))
    return g.join(g.groupBy("label").agg(F.percentile("gap", 0.95).alias("cut")), "label").where("gap > cut").select("label", "vec_id", "gap")


@query("select page_id, url || ' ' || page_id as sparse_text, case when page_id in (select item_id from benchmark) then 'listed' else 'other' end as kind from pages")
def D6_S14_sparse_text(spark, d):
    listed = table(spark, d, "benchmark").select(F.col("item_id").alias("page_id"), F.lit("listed").alias("kind")).distinct()
    rows = table(spark, d, "pages").join(listed, "page_id", "left")
    return rows.select("page_id", F.concat_ws(" ", "url", F.col("page_id").cast("string")).alias("sparse_text"), F.coalesce("kind", F.lit("other")).alias("kind"))
