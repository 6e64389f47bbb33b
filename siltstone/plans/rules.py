"""Queries over a small fixture of sources, whose rows are known, and further forms, blocks and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as fn
from siltstone.operators import chunks, codegraph, ranking, retrieval
from siltstone.plans.catalog import _RANKED, _ranked, query, table

#: Sources with the cases that matter: packages, relative and star imports, nesting, branches, a file that doesn't parse.
SOURCES = [
    ("pkg/__init__.py", "from .base import Base\n"),
    ("pkg/base.py", "import os\n\nLIMIT = 3\n\nclass Base:\n    def __init__(self):\n        self.n = 0\n\n    def run(self):\n        def inner():\n            return 1\n        return inner()\n"),
    ("pkg/sub/child.py", "from ..base import Base as B\nfrom . import tools\nimport pkg.base as pb\n\nclass Child(B):\n    async def __init__(self):\n        pass\n\n    class Part:\n        def size(self):\n            return 2\n"),
    ("pkg/sub/tools.py", "from pkg.base import *\nfrom pkg.base import LIMIT\n\nif True:\n    def helper():\n        return 1\nelse:\n    def other():\n        return 2\n"),
    ("pkg/broken.py", "def x(:\n"),
    ("docs/readme.txt", "class Not: pass"),
    ("tests/test_x.py", "import pkg\n\ndef test_it():\n    pass\n"),
    ("empty.py", ""),
]


def _known(spark):
    return codegraph.facts(spark.createDataFrame(SOURCES, "path string, text string"))


@query("""select * from (values ('/', 'directory', 0, 0), ('pkg', 'directory', 0, 0), ('pkg/sub', 'directory', 0, 0), ('tests', 'directory', 0, 0),
('pkg/__init__.py', 'file', 0, 0), ('pkg/base.py', 'file', 0, 0), ('pkg/sub/child.py', 'file', 0, 0), ('pkg/sub/tools.py', 'file', 0, 0), ('pkg/broken.py', 'file', 0, 0), ('tests/test_x.py', 'file', 0, 0), ('empty.py', 'file', 0, 0),
('pkg/base.py:Base', 'class', 5, 12), ('pkg/base.py:Base.run', 'function', 9, 12), ('pkg/base.py:Base.run.inner', 'function', 10, 11), ('pkg/sub/child.py:Child', 'class', 5, 11), ('pkg/sub/child.py:Child.__init__', 'function', 6, 7),
('pkg/sub/child.py:Child.Part', 'class', 9, 11), ('pkg/sub/child.py:Child.Part.size', 'function', 10, 11), ('pkg/sub/tools.py:helper', 'function', 5, 6), ('pkg/sub/tools.py:other', 'function', 8, 9), ('tests/test_x.py:test_it', 'function', 3, 4)) v(id, type, start_line, end_line)""")
def G1_nodes(spark, d):
    return codegraph.nodes(_known(spark)).fillna(0, ["start_line", "end_line"])


@query("""select * from (values ('/', 'pkg'), ('pkg', 'pkg/sub'), ('/', 'tests'), ('/', 'empty.py'), ('pkg', 'pkg/__init__.py'), ('pkg', 'pkg/base.py'), ('pkg/sub', 'pkg/sub/child.py'), ('pkg/sub', 'pkg/sub/tools.py'), ('tests', 'tests/test_x.py'),
('pkg/base.py', 'pkg/base.py:Base'), ('pkg/base.py:Base', 'pkg/base.py:Base.run'), ('pkg/base.py:Base.run', 'pkg/base.py:Base.run.inner'), ('pkg/sub/child.py', 'pkg/sub/child.py:Child'), ('pkg/sub/child.py:Child', 'pkg/sub/child.py:Child.__init__'),
('pkg/sub/child.py:Child', 'pkg/sub/child.py:Child.Part'), ('pkg/sub/child.py:Child.Part', 'pkg/sub/child.py:Child.Part.size'), ('pkg/sub/tools.py', 'pkg/sub/tools.py:helper'), ('pkg/sub/tools.py', 'pkg/sub/tools.py:other'), ('tests/test_x.py', 'tests/test_x.py:test_it')) v(src, dst)""")
def G2_contains(spark, d):
    return codegraph.contains(_known(spark))


@query("""select * from (values ('pkg/__init__.py', 'pkg/base.py:Base', null), ('pkg/sub/child.py', 'pkg/base.py:Base', 'B'), ('pkg/sub/child.py', 'pkg/sub/tools.py', null), ('pkg/sub/child.py', 'pkg/base.py', 'pb'),
('pkg/sub/tools.py', 'pkg/base.py', null), ('pkg/sub/tools.py', 'pkg/base.py', null), ('tests/test_x.py', 'pkg/__init__.py', null)) v(src, dst, alias)""")
def G3_imports(spark, d):
    return codegraph.imports(_known(spark))


#: Sources that call and inherit: by scope, through packages, by alias.
CALLS = [
    ("a/__init__.py", "from a.core import Core, make as build\n"),
    ("a/core.py", "def deco(f):\n    return f\n\nclass Core:\n    def __init__(self):\n        self.x = make()\n\n    def step(self):\n        return self.other()\n\n    def other(self):\n        return 1\n\n@deco\ndef make():\n    def part():\n        return Core()\n    return part()\n"),
    ("b.py", "from a import Core as C, build\nimport a\n\nclass Sub(C):\n    def go(self):\n        build()\n        return self.step()\n\ndef free():\n    return go()\n"),
]


@query("""select * from (values ('a/core.py:Core', 'a/core.py:make', 'invokes'), ('a/core.py:Core.step', 'a/core.py:Core.other', 'invokes'), ('a/core.py:make', 'a/core.py:make.part', 'invokes'), ('a/core.py:make.part', 'a/core.py:Core', 'invokes'),
('b.py:Sub', 'a/__init__.py', 'inherits'), ('b.py:Sub.go', 'a/core.py:make', 'invokes'), ('b.py:Sub.go', 'a/core.py:Core.step', 'invokes'), ('b.py:free', 'b.py:Sub.go', 'invokes')) v(src, dst, type)""")
def G4_uses(spark, d):
    return codegraph.uses(codegraph.facts(spark.createDataFrame(CALLS, "path string, text string")))


@query("select * from (values ('class', 3), ('directory', 4), ('file', 7), ('function', 7)) v(type, n)")
def G8_nodes_by_type(spark, d):
    return codegraph.nodes(_known(spark)).groupBy("type").agg(F.count("*").alias("n"))


@query("""select * from (values ('q1', 'entity', 'pkg/base.py:Base.run', 1), ('q1', 'entity', 'pkg/sub/tools.py:helper', 2), ('q1', 'module', 'pkg/base.py:Base', 1), ('q1', 'module', 'pkg/sub/child.py:Child', 2),
('q2', 'entity', 'pkg/sub/child.py:Child.Part.size', 1), ('q2', 'module', 'pkg/sub/child.py:Child', 1)) v(query_id, kind, id, place)""")
def M3_mapped_spans(spark, d):
    blocks = [("q1", 1, "pkg/base.py", ["Base.run", "Base", "nothing"]), ("q1", 2, "pkg/sub/child.py", ["Child"]), ("q1", 3, "pkg/sub/tools.py", ["helper", "helper"]), ("q2", 1, "pkg/sub/child.py", ["Child.Part.size"]), ("q2", 2, "other.py", ["Base"])]
    b = spark.createDataFrame(blocks, "query_id string, rank int, file_path string, span_ids array<string>")
    return ranking.mapped(b, codegraph.nodes(_known(spark)), modules=2)


@query("""with recursive l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as x from documents),
n as (select *, i - row_number() over (partition by doc_id order by i) as island from l where trim(x, ' ') <> ''),
p as (select *, (row_number() over (partition by doc_id, island order by i) - 1) // 15 as part from n),
k as (select doc_id, island, part, count(*) as n, row_number() over (partition by doc_id order by min(i)) as k from p group by doc_id, island, part),
f(doc_id, k, cur, grp, total) as (select doc_id, k, n, cast(1 as bigint), n from k where k = 1
  union all select k.doc_id, k.k, case when f.cur + k.n <= 15 then f.cur + k.n else k.n end, case when f.cur + k.n <= 15 then f.grp else f.grp + 1 end, f.total + k.n from f join k on k.doc_id = f.doc_id and k.k = f.k + 1 where f.total < 5000)
select doc_id, cast(min(i) as int) as start_line, cast(max(i) as int) as end_line, md5(string_agg(x, chr(10) order by i)) as content from f join k using (doc_id, k) join p using (doc_id, island, part) group by doc_id, grp""")
def C4_rl_mini(spark, d):
    return chunks.islands(table(spark, d, "documents")).withColumn("content", F.md5("content"))


@query("""with c as (select doc_id, text, substr(text, 101, 200) as part from documents where text is not null), s as (select *, strpos(text, part) as p from c)
select doc_id, cast(length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) as int) as start_line,
cast(length(substr(text, 1, p - 1)) - length(replace(substr(text, 1, p - 1), chr(10), '')) + length(part) - length(replace(part, chr(10), '')) as int) as end_line from s""")
def C16_recovered_lines(spark, d):
    docs = table(spark, d, "documents").where("text is not null").withColumn("part", F.substring("text", 101, 200))
    return docs.select("doc_id", *chunks.recovered(F.col("text"), F.col("part")))


@query("select doc_id, case when starts_with(text, 'File:') then text else 'file path: ' || source || chr(10) || 'lines: 0-' || (n_chars % 50) || chr(10) || chr(10) || text end as content from documents where doc_id % 2 = 0 union all select doc_id, 'File: ' || text from documents where doc_id % 2 <> 0")
def F27_embedded_text(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("File: "), F.col("text")))
    return table(spark, d, "documents").select("doc_id", fn.embed_text(F.col("source"), F.lit(0), F.col("n_chars") % 50, text).alias("content"))


@query("""with v as (select vec_id, vec_id % 5 as lead, embedding as e from embeddings), t as (select vec_id, lead, [e[1:16], e[17:32], e[33:48], e[49:64]] as t, [case when lead <= 0 then 1 else 0 end, case when lead <= 1 then 1 else 0 end, case when lead <= 2 then 1 else 0 end, case when lead <= 3 then 1 else 0 end] as m from v),
p as (select vec_id, t, m, cast(list_sum(m) as bigint) as n, case when lead >= 4 then 1 else lead + 1 end as f from t)
select vec_id, round(cast(t[1][1] as double), 6) as cls, round(cast(t[f][1] as double), 6) as first, round(cast(t[greatest(n, 1)][1] as double), 6) as last,
round(list_sum(list_transform([1, 2, 3, 4], lambda i: cast(t[i][1] as double) * m[i])) / greatest(n, 1e-6), 6) as mean from p""")
def F28_pooled(spark, d):
    parts = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    mask = F.array(*[F.when(F.col("vec_id") % 5 <= i, 1).otherwise(0).cast("long") for i in range(4)])
    forms = (("cls", "cls"), ("first", "first_non_pad"), ("last", "last_token"), ("mean", "mean"))
    return table(spark, d, "embeddings").select("vec_id", *[F.round(fn.pooled(parts, mask, how)[0].cast("double"), 6).alias(n) for n, how in forms])


@query(f"""with {_RANKED}, a as (select q, i, s from s where r <= 50), b as (select q, i, s * 1.001 as s from s where r between 4 and 53),
j as (select coalesce(a.q, b.q) as q, a.s as x, b.s as y from a full join b on a.q = b.q and a.i = b.i)
select q as query_id, round(cast(count(*) filter (x is not null and y is not null) as double) / count(*), 6) as jaccard, round(avg(y) - avg(x), 3) as gain,
cast(count(*) filter (x is not null and y is not null) as double) / count(*) >= 0.85 and avg(y) - avg(x) <= 0.002 as settled from j group by q""")
def P3_settled(spark, d):
    ranked = retrieval.top(_ranked(spark, d), 53)
    now = ranked.where("rank >= 4").withColumn("rank", F.col("rank") - 3).withColumn("score", F.col("score") * 1.001)
    return ranking.stable(ranked, now, 50, 0.85).withColumns({"jaccard": F.round("jaccard", 6), "gain": F.round("gain", 3)})


@query(r"select page_id, regexp_replace(url, '^https?://', '') as path from pages where regexp_matches(regexp_replace(url, '^https?://', ''), '^(.*/)?[^/]*[.]example[.](com|net|org)/de/[0-9][^/]*$')")
def S13_glob(spark, d):
    paths = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return chunks.matching(paths, ["*.example.com/de/[0-9]*", "*.example.net/de/[0-9]*", "*.example.org/de/[0-9]*"])


@query("select event_type as id, max_by(event_id, event_id) as event_id from events group by event_type")
def S8_last_of_each(spark, d):
    from siltstone.operators import graphs

    return graphs.latest(table(spark, d, "events").select(F.col("event_type").alias("id"), "event_id"), ["id"], [F.desc("event_id")])


@query("select o_orderkey, length(o_orderpriority) > 0 and o_orderstatus is not null as valid from orders")
def F6_valid_results(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.coalesce(F.length("o_orderpriority") > 0, F.lit(False)) & F.col("o_orderstatus").isNotNull()).alias("valid"))


@query("""with q as (select vec_id as query_id, embedding as q0 from embeddings where vec_id % 50 = 0),
a as (select query_id, vec_id as doc_id, round(list_sum(list_transform(list_zip(q0, embedding), lambda z: cast(z[1] as double) * z[2])), 6) as score, embedding from q, embeddings),
r1 as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from a),
w as (select *, exp((score - max(score) over (partition by query_id)) / 0.05) as w from r1 where rank <= 8),
e as (select query_id, w, unnest(range(0, len(embedding))) as i, unnest(embedding) as x from w), c0 as (select query_id, i, sum(w * cast(x as double)) / sum(w) as c from e group by all),
c as (select query_id, i, c / sqrt(sum(c * c) over (partition by query_id)) as c from c0), o as (select query_id, unnest(range(0, len(q0))) as i, unnest(q0) as q from q),
n as (select query_id, i, 0.65 * cast(q as double) + 0.35 * c as x from o join c using (query_id, i)), m as (select query_id, i, x / sqrt(sum(x * x) over (partition by query_id)) as x from n),
q1 as (select query_id, list(x order by i) as q1 from m group by query_id),
b as (select query_id, vec_id as doc_id, round(list_sum(list_transform(list_zip(q1, embedding), lambda z: z[1] * cast(z[2] as double))), 6) as score from q1, embeddings),
r2 as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b),
u as (select query_id, doc_id, rank from r1 where rank <= 20 union all select query_id, doc_id, rank from r2 where rank <= 20), s as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as score from u group by all),
f as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, score, rank, 2 as rounds from f where rank <= 10""")
def P1_feedback_rounds(spark, d):
    from siltstone.operators import feedback

    v = table(spark, d, "embeddings")
    return feedback.rounds(v, v.where("vec_id % 50 = 0"), k=10, expand=20, most=2, drift=-1)


@query("""select * from (values ('pkg/base.py', 'Base::__init__', 5, 6, 1), ('pkg/base.py', 'Base::run', 8, 11, 1), ('pkg/base.py', 'Base::inner', 9, 10, 1), ('pkg/sub/child.py', 'Child::__init__', 5, 6, 1), ('pkg/sub/child.py', 'Part::size', 9, 10, 1),
('pkg/sub/tools.py', 'helper', 4, 5, 1), ('tests/test_x.py', 'test_it', 2, 3, 1)) v(path, qualified_name, start_line, end_line, complexity)""")
def C5_function_blocks(spark, d):
    from siltstone.operators import code

    return code.functions(spark.createDataFrame(SOURCES, "path string, text string").where("path like '%.py'")).select("path", "qualified_name", "start_line", "end_line", "complexity")
