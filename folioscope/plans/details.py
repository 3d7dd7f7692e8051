"""More registered queries: scalars, projections, sinks, file round trips and the evaluation of a flat XML file."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import scalars
from folioscope.operators import bow, evaluate, images, joins, rules_engine, selection
from folioscope.plans.catalog import _FAMILY, _HITS, _MATRIX, FAMILY, LANGS, _as_articles, _re2, query, table
from folioscope.rules import LANGUAGE_RULES
from folioscope.shared import place
from folioscope.sources import articles as art
from folioscope.sources import files, sinks


@query("select page_id, 'im' || page_id as bare, 'im' || page_id || '.x' as image, trim('  a ' || page_id || ' ') as trimmed, url like '%example%' as has_example, len(string_split(url, '/'))::int as parts from pages")
def scalar_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id").cast("string")
    return p.select(
        "page_id", scalars.strip_suffix(F.concat(F.lit("im"), n, F.lit(".jpg"))).alias("bare"), scalars.strip_index(F.concat(F.lit("im"), n, F.lit(".x:"), n)).alias("image"),
        F.trim(F.concat(F.lit("  a "), n, F.lit(" "))).alias("trimmed"), F.col("url").contains("example").alias("has_example"), F.size(F.split("url", "/")).alias("parts"),
    )


@query("select p_partkey, case when p_size % 3 = 0 then null else p_size end::int as i, case when p_size % 3 = 0 then null else p_size + 0.5 end::float as f from part")
def scalar_casts(spark, sf_dir):
    size = F.col("p_size").cast("int")
    odd = F.when(size % 3 == 0, F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.to_int(F.coalesce(odd, F.concat(F.lit(" "), size.cast("string"), F.lit(" ")))).alias("i"), scalars.to_float(F.coalesce(odd, F.concat(size.cast("string"), F.lit(".5")))).alias("f"))


@query("select c_custkey, unnest([c_mktsegment, c_mktsegment || ':a', ':a', c_mktsegment || ':' || c_nationkey, ':' || c_nationkey]) as term from customer")
def heading_expansion(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(scalars.heading_terms(F.col("c_mktsegment"), F.array(F.lit("a"), F.col("c_nationkey").cast("string")))).alias("term"))


@query("select l_orderkey, l_linenumber, round(case when l_discount < 1e-6 then 0 else l_discount * ln(l_discount) end, 9) + 0.0 as natural, round(case when l_discount < 1e-6 then 0 else l_discount * log2(l_discount) end, 9) + 0.0 as bits from lineitem")
def x_log_x(spark, sf_dir):
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(scalars.x_log_x(d), 9) + 0.0).alias("natural"), (F.round(scalars.x_log_x(d, 2.0), 9) + 0.0).alias("bits"))


@query("""with s as (select vec_id, list_transform(embedding, lambda x: case when x > 0.2 then 1 else 0 end) as v from embeddings), n as (select vec_id, v, list_sum(v)::int as k from s)
select vec_id, i::int - 1 as i, 1.0::double as x from (select vec_id, unnest(generate_series(1, len(v))) as i, unnest(v) as x from n where len(v) > 10 and k * 4 < len(v)) where x <> 0""")
def sparse_entries(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.when(x > F.lit(0.2).cast("float"), 1.0).otherwise(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.inline(bow.sorted_entries(F.reverse(scalars.sparse(v)))))


@query("select c_custkey, greatest(c_nationkey, 7)::int as a, (case when c_nationkey > 12 then 1 else 2 end)::int as b, c_nationkey::int as got, -1 as missing from customer")
def map_merge(spark, sf_dir):
    n = F.col("c_nationkey").cast("int")
    one, two = F.create_map(F.lit("a"), n), F.create_map(F.lit("a"), F.lit(7), F.lit("b"), F.when(n > 12, 1).otherwise(2))
    m = scalars.map_greatest(one, two)
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(m, F.lit("a")).alias("a"), F.element_at(m, F.lit("b")).alias("b"), scalars.map_get(one, F.lit("a"), F.lit(-1)).alias("got"), scalars.map_get(one, F.lit("z"), F.lit(-1)).alias("missing"))


@query("select p_partkey, p_size::double as first, 2.5::double as last, 2 as n from part")
def descriptor_texts(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("tamura 2 "), size, F.lit(" 2.5"))).otherwise(F.concat(F.lit("edge;"), size, F.lit(";2.5")))
    v = table(spark, sf_dir, "part").select("p_partkey", scalars.descriptor_vector(text).alias("v"))
    return v.select("p_partkey", F.col("v")[0].alias("first"), F.col("v")[1].alias("last"), F.size("v").alias("n"))


@query("select doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{_re2(r.pattern)}'), false)::int as regex_{i}" for i, r in enumerate(LANGUAGE_RULES)) + " from documents")
def rule_columns(spark, sf_dir):
    return rules_engine.wide(table(spark, sf_dir, "documents"), "doc_id", "text", LANGUAGE_RULES)


@query("select l_orderkey, l_discount, l_tax, l_linenumber from lineitem")
def prefix_columns(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("f_discount"), F.col("l_tax").alias("f_tax"), "l_returnflag", "l_linenumber")
    kept = selection.by_prefix(t, "f_", "l_orderkey", "l_linenumber")
    selection.require_numeric(kept)
    return kept.withColumnsRenamed({"f_discount": "l_discount", "f_tax": "l_tax"})


@query("select o_orderkey, o_orderstatus, o_orderdate from orders")
def column_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return o.select(selection.parse_ranges("first,3,last", o.columns))


@query("with a as (select c_custkey as k, c_name as name from customer), b as (select o_custkey as k, min(o_orderpriority) as priority from orders group by 1) select k, name, priority from a full join b using (k) where length(priority) > 0")
def merge_complete(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").alias("at"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_orderpriority").alias("at"))
    return joins.merge_outer([a, b], order="at", complete=True)


@query("select p_partkey, 'T' || p_partkey as title, 'A, B; C, D' as authors, 'J 2001;' || p_size || '(2):3-4' as source_text, 'x' as abstract from part")
def citation_parts(spark, sf_dir):
    xml = F.concat(F.lit("<r><ArticleTitle>T"), F.col("p_partkey").cast("string"), F.lit("</ArticleTitle><Journal><ISOAbbreviation>J</ISOAbbreviation><JournalIssue><Volume>"), F.col("p_size").cast("string"), F.lit("</Volume><Issue>2</Issue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal><Pagination><MedlinePgn>3-4</MedlinePgn></Pagination><AbstractText>x</AbstractText><AuthorList><Author><LastName>A</LastName><Initials>B</Initials></Author><Author><LastName>C</LastName><Initials>D</Initials></Author></AuthorList></r>"))
    # The table's few bytes a row make few tasks, so rows are dealt before texts are made and parsed.
    return files.citation(table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey").select("p_partkey", xml.alias("xml"))).drop("xml")


@query("select vec_id || ',' || array_to_string(list_transform(embedding, lambda x: floor(x::double * 1000)::bigint), ',') as line from embeddings")
def vector_lines(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)).alias("v"))
    return sinks.vector_lines(v, "v", "vec_id")


@query("select doc_id::varchar as id, lang as caption from documents")
def tab_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "lang", F.lit("more")).alias("value")).unionByName(spark.range(3).select(F.lit(" ").alias("value")))
    return files.tab_pairs(lines)


@query("select 'doi_' || replace('10.1/' || doc_id, '/', '_') || '.xml' as name, doc_id from documents")
def citation_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(sinks.citation_name(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))).alias("name"), "doc_id")


@query("""with u as (select doc_id, unnest([doc_id || '_a', doc_id || '_b']) as g from documents) select u.g as graphic_id, d.lang as code from u join documents d using (doc_id)""")
def ground_truth_file(spark, sf_dir):
    """Lines of ground truth, written, read and checked."""
    path = place(spark, "truth")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("g"), "lang")
    sinks.write_lines(d.select(F.concat("id", F.lit("_"), "g", F.lit(".jpg, "), "lang").alias("line")), path)
    return files.ground_truth(spark, path, LANGS)


@query("select n_nationkey::double as n_nationkey, n_name, n_regionkey::double as n_regionkey from nation")
def typed_csv_file(spark, sf_dir):
    path = place(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.typed_csv(spark, path, sep=",")


@query("select n_name as key, n_nationkey::varchar as value from nation")
def delimited_map_file(spark, sf_dir):
    path = place(spark, "map")
    sinks.write_lines(table(spark, sf_dir, "nation").select(F.concat_ws("=", "n_name", F.col("n_nationkey").cast("string")).alias("line")).coalesce(1), path)
    return files.delimited_map(spark, path, "=")


@query("select 'c' || r_regionkey as label, r_regionkey::int as id from region")
def class_map_file(spark, sf_dir):
    path = place(spark, "classes")
    sinks.write_lines(table(spark, sf_dir, "region").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string"), F.lit(" "), F.col("r_regionkey").cast("string")).alias("line")), path)
    return files.class_map(spark, path)


@query("select distinct c_mktsegment as id from customer")
def id_list_file(spark, sf_dir):
    path = place(spark, "ids")
    sinks.write_lines(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("line")).distinct(), path)
    return files.id_list(spark, path)


@query("select lang as grp, count(*) as n from documents group by 1 union all select 'all', count(*) from documents")
def union_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang")
    return d.withColumnRenamed("lang", "grp").unionByName(d.select(F.lit("all").alias("grp"))).groupBy("grp").agg(F.count("*").alias("n"))


def _drawn(spark, sf_dir):
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127))).cast("int"))
    data = F.unhex(F.array_join(F.transform(grey, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))


@query()
def image_features_all(spark, sf_dir):
    """Each extractor on embeddings that are drawn as 8 x 8 grey images."""
    return images.extract(_drawn(spark, sf_dir), "mean,skin,lines,entropy")


#: The flat form knows only the label dimension's codes; each language takes one of them.
CODES = {"de": "CT", "en": "MR", "es": "PX", "fr": "GL"}


@query(_HITS + _MATRIX + f", fam as (select {_FAMILY.format('gold')} as g, {_FAMILY.format('pred')} as p, n from m where n > 0) select 'label' as level, gold, pred, n from m where n > 0 union all select 'group', g, p, sum(n)::bigint from fam group by g, p")
def flat_xml_evaluation(spark, sf_dir):
    """Articles written as flat XML with their predictions and read again; truth looked up; the first graphic of an id that has a truth counts; both levels of the matrix."""
    path = place(spark, "flat")
    predicted = rules_engine.predict_articles(_as_articles(spark, sf_dir), LANGUAGE_RULES)
    code = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    back = F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (v, k)])
    coded = lambda g: F.struct(g["id"].alias("id"), F.transform_keys(g["predictions"], lambda k, _: F.element_at(code, k)).alias("predictions"))
    one = predicted.withColumn("figures", F.transform("figures", lambda f: F.struct(f["id"].alias("id"), f["label"].alias("label"), F.lit("caption").alias("caption"), f["references"].alias("references"), F.transform(f["graphics"], coded).alias("graphics"))))
    art.write_flat(one, path)
    read = art.graphics(art.read_flat(spark, path)).select(F.col("graphic_id").alias("id"), F.transform_keys("predictions", lambda k, _: F.element_at(back, k)).alias("predictions"))
    truth = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_a")).alias("id"), F.col("lang").alias("gold"))
    pred = rules_engine.argmax_label(F.col("predictions"), LANGS, "NONE")
    pairs = read.select("id", pred.alias("pred"), F.col("id").alias("at")).join(truth, "id")
    pairs = joins.first_by(pairs, ["id"], "at").select("gold", "pred")
    groups = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("grp")) for k, v in FAMILY.items()])))
    by_label = evaluate.confusion(pairs)
    by_group = evaluate.merge(evaluate.by_group(by_label, groups))
    return by_label.select(F.lit("label").alias("level"), "gold", "pred", "n").unionByName(by_group.select(F.lit("group").alias("level"), "gold", "pred", "n"))


@query("select (doc_id % 10) || chr(9) || (quality + 1) || ':q' || quality || chr(9) || (toxic + 1) || ':q' || toxic || chr(9) || case when quality = toxic then '' else '+' end || chr(9) || '(' || doc_id || ')' as line from labels")
def validation_lines(spark, sf_dir):
    name = lambda c: F.concat(F.lit("q"), F.col(c).cast("string"))
    scored = table(spark, sf_dir, "labels").select("doc_id", F.pmod("doc_id", F.lit(10)).cast("int").alias("fold"), name("quality").alias("gold"), name("toxic").alias("pred"))
    return sinks.validation_lines(scored, "doc_id", ["q0", "q1"])
