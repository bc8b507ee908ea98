"""The registered queries: every operator over the given tables, with flat columns for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cratewise.functions import category as C
from cratewise.functions import present as P
from cratewise.functions import text as T
from cratewise.functions import variant as V
from cratewise.operators import components as K
from cratewise.operators import graph as G
from cratewise.operators import merge as M
from cratewise.operators import quality as Q
from cratewise.operators import quota as U
from cratewise.operators import reach as B
from cratewise.operators import search as S
from cratewise.operators import segments as X
from cratewise.operators import star as R
from cratewise.operators.normalize import normalize, normalize_map
from cratewise.plans import standins as D
from cratewise.session import materialize, run_folder
from cratewise.sources import catalog as L
from cratewise.sources import changes as H
from cratewise.sources import documents as O
from cratewise.sources.snapshot import explode_map, read_snapshot, write_snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Start nodes of the graph queries.
SEED = "195"
TARGET = "16"
SAMPLE_SIZE = 100


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(items: Column) -> Column:
    """A list as one text, for results without nested columns."""
    return F.coalesce(F.array_join(items, "|"), F.lit(""))


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


# --- text search ------------------------------------------------------------------------------


WRITTEN: dict[tuple[str, str], str] = {}


def _output(spark: SparkSession, name: str) -> str:
    """A new place in the session's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def text_index(spark: SparkSession, sf_dir: str) -> S.SearchIndex:
    """The written index of the corpus; a session writes it once for each folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in WRITTEN:
        path = _output(spark, "index")
        S.write_index(S.build_index(D.corpus(spark, sf_dir), "id", S.STORE_COLUMNS, keep=["category", "broken", "unfree"]), path)
        WRITTEN[key] = path
    return S.read_index(spark, WRITTEN[key])


@query
def index_written(spark, sf):
    """What is in the written index, after it is read back."""
    index = text_index(spark, sf)
    documents, lengths = (index.docs.select(c).scalar() for c in [F.count(F.lit(1)), F.sum("dl")])
    counts = index.postings.agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))
    return counts.select("postings", "tokens", documents.alias("documents"), lengths.alias("lengths"))


def everything(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", rounded(F.col("score")))


@query
def bm25_topk(spark, sf):
    """Ten best documents for two terms."""
    return everything(S.search(text_index(spark, sf), "in the", limit=10, include_broken=True, include_unfree=True))


@query
def bm25_page2(spark, sf):
    """the second page of the same search."""
    index = text_index(spark, sf)
    return everything(S.search(index, "in the", limit=10, offset=10, include_broken=True, include_unfree=True))


@query
def bm25_by_maxima(spark, sf):
    """T4, T5: a search that leaves out the blocks whose maxima cannot reach its page."""
    return everything(
        S.search(text_index(spark, sf), "that", limit=20, offset=5, include_broken=True, include_unfree=True, query=S.make_query(spark, "that", any_of="in license"), skip_from=0)
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return D.table(spark, sf_dir, "lineitem").select(line.alias("doc_id"), F.round("l_extendedprice", 0).cast("double").alias("score"))


@query
def deep_page(spark, sf):
    """everything from row 20 000 on of all order lines by price."""
    return S.page(_lines(spark, sf), limit=-1, offset=20_000)


@query
def deep_page_window(spark, sf):
    """rows 30 000 to 30 500 of the same ranking."""
    return S.page(_lines(spark, sf), limit=500, offset=30_000)


@query
def bm25_phrase(spark, sf):
    """A quoted phrase and a term."""
    return everything(S.search(text_index(spark, sf), '"the and" of', limit=25, include_broken=True, include_unfree=True))


@query
def bm25_filtered(spark, sf):
    """Default flags, a category and a license; statistics of the whole index."""
    return everything(
        S.search(
            text_index(spark, sf), "of", limit=30, license="good-1.0", category="en", doc_licenses=D.corpus_licenses(spark, sf)
        )
    )


@query
def bm25_with_documents(spark, sf):
    """A page of hits joined to the stored documents."""
    corpus = D.corpus(spark, sf)
    stored = corpus.select(
        "id",
        F.to_json(F.struct(F.col("id").alias("package_id"), F.col("name").alias("package_name"), "description", "category")).alias("doc"),
    ).where(F.col("category") != "fr")
    hits = S.search(text_index(spark, sf), "on", limit=40, store=stored, include_broken=True, include_unfree=True)
    decoded = O.decode_documents(hits.withColumnRenamed("doc_id", "id"))
    return decoded.select(
        "id", rounded(F.col("score")).alias("score"), "package_id", "package_name", F.md5("description").alias("description_md5"), "category", "available", "is_stub"
    )


@query
def match_all(spark, sf):
    """Every match of a search with its score."""
    index = text_index(spark, sf)
    return everything(S.matches(index, S.make_query(spark, "that is")))


@query
def match_count(spark, sf):
    """Matches after filters, before paging."""
    index = text_index(spark, sf)
    return S.matches(index, S.make_query(spark, "and"), S.filter_docs(index.docs)).agg(F.count(F.lit(1)).alias("total_count"))


@query
def empty_search(spark, sf):
    """A query without tokens has no results."""
    return everything(S.search(text_index(spark, sf), " ?! ", limit=10))


@query
def term_options(spark, sf):
    """Any-of, none-of, prefix and one column."""
    wanted = S.make_query(spark, "the", any_of="einlich license", none_of="cionado", prefix="wh", in_columns={"name": "src1 "})
    wanted.required = [u for u in wanted.required if u.column != "name"]
    return everything(S.matches(text_index(spark, sf), wanted))


@query
def column_search(spark, sf):
    """A term within one column, ranked."""
    return everything(S.matches(text_index(spark, sf), S.make_query(spark, "of", in_columns={"name": "src3"})))


@query
def batch_search(spark, sf):
    """All requests of the log answered together."""
    requests = D.search_requests(spark, sf)
    typed = requests.select("request_id", *[c.alias(n) for n, c in P.request_columns(F.col("params")).items()])
    return everything(S.batch_search(text_index(spark, sf), typed, D.corpus_licenses(spark, sf)))


@query
def batch_options(spark, sf):
    """Requests with any-of, none-of and prefix terms answered together."""
    return everything(S.batch_search(text_index(spark, sf), D.option_requests(spark, sf)))


@query
def term_stats(spark, sf):
    """Document and collection frequency of every term."""
    return S.term_stats(text_index(spark, sf))


@query
def postings_top(spark, sf):
    """The hundred most frequent terms with their positions summed."""
    sums = text_index(spark, sf).postings.groupBy("term").agg(
        F.sum("tf").alias("cf"),
        F.count(F.lit(1)).alias("postings"),
        F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p)).alias("position_sum"),
    )
    return sums.orderBy(F.desc("cf"), "term").limit(100)


def changed_index(spark: SparkSession, sf_dir: str) -> S.SearchIndex:
    """The corpus after a third of it was replaced, deleted and added in four changes that were merged."""
    corpus = D.corpus(spark, sf_dir)
    path = _output(spark, "segments")

    def built(docs: DataFrame) -> S.SearchIndex:
        return S.build_index(docs, "id", S.STORE_COLUMNS, keep=["category", "broken", "unfree"])

    number = F.col("id").cast("bigint")
    X.create(built(corpus), path)
    X.change(built(D.revised(corpus.where(number % 18 == 1))), path)
    X.change(built(corpus.limit(0)), path, corpus.where(number % 9 == 4).select(F.col("id").alias("doc_id")))
    X.change(built(D.revised(corpus.where(number % 18 == 10))), path)
    X.merge(spark, path, factor=3)
    X.change(built(corpus.where(number % 9 == 7).withColumn("id", F.concat(F.lit("new"), "id"))), path)
    return X.read(spark, path)


@query
def segment_terms(spark, sf):
    """The terms of an index after changes, as those of a fresh one."""
    return S.term_stats(changed_index(spark, sf))


@query
def segment_search(spark, sf):
    """A search in the same index."""
    return everything(S.search(changed_index(spark, sf), "revised in", limit=40, include_broken=True, include_unfree=True))


@query
def document_lengths(spark, sf):
    """Token counts per document and of the corpus."""
    index = text_index(spark, sf)
    return index.docs.select("doc_id", "dl", index.corpus.select(rounded(F.col("avgdl"))).scalar().alias("avgdl"))


# --- dependency graph ---------------------------------------------------------------------------


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored edges and the vertices; the loops below read the edges many times."""
    return materialize(D.part_edges(spark, sf_dir), "edges").df, D.part_nodes(spark, sf_dir)


def partner_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each part with its strongest partner: many components, and closures that stay small."""
    return materialize(D.partner_edges(spark, sf_dir), "partners").df, D.part_nodes(spark, sf_dir)


def layered_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All lines, nearly without cycles: many components over every edge."""
    return materialize(D.layered_edges(spark, sf_dir), "layered").df, D.part_nodes(spark, sf_dir)


def _list_rows(pages: DataFrame) -> DataFrame:
    return pages.select("node_id", "page", F.size("items").alias("n"), joined(F.col("items")).alias("items"))


@query
def direct_deps(spark, sf):
    """Direct dependencies."""
    return _list_rows(G.neighbors(D.part_edges(spark, sf), "out"))


@query
def direct_dependents(spark, sf):
    """Direct dependents."""
    return _list_rows(G.neighbors(D.part_edges(spark, sf), "in"))


@query
def degree_stats(spark, sf):
    """In- and out-degree of every node."""
    return G.degrees(D.part_edges(spark, sf), D.part_nodes(spark, sf))


@query
def degree_extremes(spark, sf):
    """The degree part of the summary row."""
    row = G.degree_summary(G.degrees(D.part_edges(spark, sf), D.part_nodes(spark, sf)))
    return row.withColumns({c: rounded(F.col(c)) for c in row.columns if c.startswith("average")})


@query
def leaderboard_out(spark, sf):
    """most dependencies."""
    return G.leaderboard(G.degrees(D.part_edges(spark, sf), D.part_nodes(spark, sf)), "out_degree").select("node_id", "out_degree")


@query
def leaderboard_in(spark, sf):
    """most dependents."""
    return G.leaderboard(G.degrees(D.part_edges(spark, sf), D.part_nodes(spark, sf)), "in_degree").select("node_id", "in_degree")


@query
def multigraph_degrees(spark, sf):
    """E8 with multiplicity: parallel edges count by weight."""
    lines = D.table(spark, sf, "lineitem")
    left = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").cast("string").alias("src"))
    right = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("dst"))
    weighted = left.join(right, ["l_orderkey", "n"]).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return G.degrees(weighted, D.part_nodes(spark, sf))


@query
def closure_counts(spark, sf):
    """The four counts of every node."""
    return G.with_flags(B.bitset_counts(*partner_graph(spark, sf)))


@query
def closure_pairs(spark, sf):
    """All reachable pairs with their distance, by source."""
    edges, _ = partner_graph(spark, sf)
    return G.closure(edges).groupBy("src").agg(
        F.count(F.lit(1)).alias("reached"), F.max("hops").alias("farthest"), F.sum("hops").alias("hop_sum")
    )


@query
def reach_from_seed(spark, sf):
    """Everything a few seed nodes depend on, with distances."""
    edges, nodes = part_graph(spark, sf)
    return G.closure(edges, seeds=nodes.where(F.col("node_id").isin(SEED, TARGET)))


@query
def reach_into_seed(spark, sf):
    """Everything that depends on the seeds."""
    edges, nodes = part_graph(spark, sf)
    return G.closure(edges, seeds=nodes.where(F.col("node_id").isin(SEED, TARGET)), direction="in")


def _farthest(edges: DataFrame) -> str:
    """A node as far from the seed as any, so that the path query has a path to find."""
    reach = G.closure(edges, edges.sparkSession.createDataFrame([(SEED,)], "node_id string"))
    far = reach.where(F.col("dst") != SEED).orderBy(F.desc("hops"), "dst").first()
    return far["dst"] if far else SEED


@query
def shortest_path(spark, sf):
    """The path from the seed to the node farthest from it."""
    edges, nodes = part_graph(spark, sf)
    return G.shortest_path(edges, nodes, SEED, _farthest(edges))


@query
def dependency_facts(spark, sf):
    """Lists and counts of every node."""
    edges, nodes = partner_graph(spark, sf)
    facts = G.with_flags(G.dependency_facts(edges, nodes, B.reach_pairs(edges, nodes)))
    lists = ["direct_dependencies", "direct_dependents", "all_dependencies", "all_dependents"]
    return facts.withColumns({c: joined(F.col(c)) for c in lists})


@query
def wcc_sizes(spark, sf):
    """Weakly connected components and their sizes."""
    return K.wcc(*part_graph(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query
def scc_sizes(spark, sf):
    """Strongly connected components and their sizes."""
    return K.scc(*partner_graph(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query
def cycle_edges(spark, sf):
    """I8: edges on cycles, with all partners of a part."""
    edges, nodes = part_graph(spark, sf)
    return K.cycle_edges(edges, K.scc(edges, nodes))


@query
def cycle_witnesses(spark, sf):
    """I8: one shortest cycle per component."""
    edges, nodes = partner_graph(spark, sf)
    found = K.cycles(edges, materialize(K.scc(edges, nodes), "scc").df)
    return found.select("component", F.size("cycle").alias("length"))


@query
def graph_summary(spark, sf):
    """The statistics row."""
    row = K.graph_summary(*partner_graph(spark, sf))
    return row.withColumns({c: rounded(F.col(c)) for c in row.columns if c.startswith("average")})


@query
def full_closure_counts(spark, sf):
    """The four counts of every node over all lines, by condensed components."""
    return G.with_flags(K.condensed_counts(*part_graph(spark, sf)))


@query
def full_component_reach(spark, sf):
    """The closure over all lines as components and those they reach, with their sizes."""
    edges, nodes = part_graph(spark, sf)
    components = materialize(K.scc(edges, nodes), "scc").df
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    reached = sizes.select(F.col("component").alias("reached"), F.col("size").alias("reached_size"))
    return K.component_reach(edges, components).join(sizes, "component").join(reached, "reached")


@query
def full_scc_members(spark, sf):
    """The strongly connected component of every node over all lines."""
    return K.scc(*part_graph(spark, sf))


@query
def full_cycle_edges(spark, sf):
    """I8: edges on cycles over all lines."""
    edges, nodes = part_graph(spark, sf)
    return K.cycle_edges(edges, K.scc(edges, nodes))


@query
def full_cycle_witnesses(spark, sf):
    """I8: one shortest cycle per component over all lines."""
    edges, nodes = part_graph(spark, sf)
    found = K.cycles(edges, materialize(K.scc(edges, nodes), "scc").df)
    return found.select("component", F.size("cycle").alias("length"))


@query
def full_graph_summary(spark, sf):
    """The statistics row over all lines."""
    row = K.graph_summary(*part_graph(spark, sf))
    return row.withColumns({c: rounded(F.col(c)) for c in row.columns if c.startswith("average")})


@query
def layered_closure_counts(spark, sf):
    """The four counts of every node over all lines of a graph with many components."""
    return G.with_flags(B.bitset_counts(*layered_graph(spark, sf)))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("node_id", "page", F.size("items").alias("n"), F.md5(joined(F.col("items"))).alias("items_md5"))


@query
def paged_nodes_written(spark, sf):
    """Node documents with paged lists over all lines, written, and looked up for the parts of one size."""
    edges, nodes = layered_graph(spark, sf)
    path = _output(spark, "nodes")
    O.write_paged_nodes(nodes, B.all_pages(edges, nodes, width=512), path)
    docs, pages = O.read_paged_nodes(spark, path, nodes.where("p_size = 15"))
    relation = F.explode(F.from_json(F.get_json_object("doc", "$.relations"), "map<string, struct<count: bigint, pages: bigint>>")).alias("relation", "of")
    listed = pages.groupBy("node_id", "relation").agg(F.md5(joined(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "items"))), lambda p: p["items"])))).alias("items_md5"))
    told = docs.select("node_id", F.get_json_object("doc", "$.p_name").alias("p_name"), relation).select("node_id", "p_name", "relation", "of.count", "of.pages")
    return told.join(listed, ["node_id", "relation"])


@query
def layered_scc_members(spark, sf):
    """Strong components of a graph with many of them, over all lines."""
    return K.scc(*layered_graph(spark, sf))


@query
def edge_cycles(spark, sf):
    """I8: a shortest cycle through every edge on a cycle, as a path, in a graph with many components over all lines."""
    edges, nodes = layered_graph(spark, sf)
    near = edges.where("abs(CAST(src AS BIGINT) - CAST(dst AS BIGINT)) <= 20")
    found = K.edge_cycles(near, materialize(K.scc(near, nodes), "scc").df)
    return found.select("component", joined(F.col("cycle")).alias("cycle"))


@query
def layered_dependency_pages(spark, sf):
    """All dependencies of every node over all lines, in pages of 512 nodes."""
    return _pages(B.reach_pages(*layered_graph(spark, sf), width=512))


@query
def layered_dependent_pages(spark, sf):
    """All dependents of every node over all lines, in pages of 512 nodes."""
    return _pages(B.reach_pages(*layered_graph(spark, sf), direction="in", width=512))


def _ego(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    edges, nodes = D.part_edges(spark, sf_dir), D.part_nodes(spark, sf_dir)
    return edges, nodes, *G.ego_graph(edges, nodes, SEED)


@query
def ego_graph(spark, sf):
    """Nodes around one node."""
    return _ego(spark, sf)[2]


@query
def ego_links(spark, sf):
    """Typed links around one node."""
    return _ego(spark, sf)[3]


@query
def expand_node(spark, sf):
    """Nodes after one of them is opened."""
    edges, nodes, ego_nodes, links = _ego(spark, sf)
    return G.expand(ego_nodes, links, edges, nodes, _smallest_neighbor(ego_nodes))[0]


@query
def expand_links(spark, sf):
    """Links after one node is opened."""
    edges, nodes, ego_nodes, links = _ego(spark, sf)
    return G.expand(ego_nodes, links, edges, nodes, _smallest_neighbor(ego_nodes))[1]


def _smallest_neighbor(ego_nodes: DataFrame) -> str:
    found = ego_nodes.where(F.col("role") != "main").agg(F.min("node_id").alias("id")).first()["id"]
    return found or SEED


@query
def node_metadata(spark, sf):
    """Metadata of asked nodes, here those of all order lines."""
    asked = D.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("node_id"))
    return G.node_metadata(D.part_nodes(spark, sf), asked)


@query
def graph_from_records(spark, sf):
    """Edges resolved from raw records by derivation path."""
    return G.build_graph(D.raw_snapshot_with_inputs(spark, sf).records)[1]


@query
def vertices_from_records(spark, sf):
    """Vertices with the metadata of their last record."""
    return G.build_graph(D.raw_snapshot_with_inputs(spark, sf).records)[0]


@query
def edge_list(spark, sf):
    """The edge-list export with its heading, read back."""
    path = _output(spark, "edge-list")
    O.write_edge_list(D.part_edges(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- normalization ------------------------------------------------------------------------------


def clean_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(D.raw_snapshot(spark, sf_dir).records, D.RUN_TS)


@query
def normalize_counts(spark, sf):
    """How many records normalization kept and dropped."""
    records = D.raw_snapshot(spark, sf).records
    return Q.normalization_counts(records, normalize(records, D.RUN_TS))


@query
def name_version(spark, sf):
    """B1: names and versions of every variant."""
    name = F.col("full_name")
    return D.variant_facts(spark, sf).select(
        "drv_path", "full_name", T.package_name(name).alias("package_name"), T.package_version(name).alias("version")
    )


@query
def store_path_name(spark, sf):
    """Names out of store paths."""
    return D.variant_facts(spark, sf).select(
        "drv_path",
        T.name_from_store_path(F.concat(F.lit("/store/h"), "l_orderkey", F.lit("-"), "full_name")).alias("name"),
    )


@query
def package_id(spark, sf):
    """Identifiers of the normalized packages."""
    return clean_packages(spark, sf).select(
        "drv_path",
        "package_id",
        "attribute_path",
        T.system_of(F.col("attribute_path")).alias("system"),
        T.node_id(F.col("package_name"), F.col("version")).alias("node_id"),
    )


@query
def sanitize(spark, sf):
    """Clean texts and the search text."""
    clean = clean_packages(spark, sf)
    parts = ["package_name", "description", "long_description", "attribute_path", "main_program"]
    return clean.select(
        "drv_path", "description", "homepage", "main_program", "last_updated", T.search_text(*[F.col(c) for c in parts]).alias("search_text")
    )


@query
def sanitize_texts(spark, sf):
    """Padded, over-long texts cut after trimming."""
    return D.table(spark, sf, "documents").select(
        "doc_id", F.md5(T.clean_text(F.concat(F.lit(" \n\u0000"), "text", F.lit("\t ")))).alias("clean_md5")
    )


@query
def category_rules(spark, sf):
    """Categories by path, over paths with every rule word."""
    words = F.array(*[F.lit(w) for ws in C.PATH_RULES.values() for w in ws], F.lit("plain"))
    word = F.element_at(words, (F.col("p_partkey") % F.size(words) + 1).cast("int"))
    path = F.concat(F.lit("Top."), F.initcap(word), F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")))
    return D.table(spark, sf, "part").select("p_partkey", path.alias("attr_path"), F.lower(path).alias("lower_path")).select(
        "p_partkey", "attr_path", C.category_of_path("lower_path").alias("category")
    )


@query
def category_map(spark, sf):
    """Catalog categories to shown ones, unmapped and empty ones included."""
    names = F.array(*[F.lit(n) for n in C.CATEGORY_NAMES], F.lit("Other.Things"), F.lit(""))
    name = F.upper(F.element_at(names, (F.col("p_partkey") % F.size(names) + 1).cast("int")))
    return D.table(spark, sf, "part").select("p_partkey", C.category_name(name).alias("category"))


@query
def package_category(spark, sf):
    """The metadata category when there is one, else the path's."""
    return clean_packages(spark, sf).select("drv_path", "category")


@query
def license_norm(spark, sf):
    """One row per license of every variant."""
    one = clean_packages(spark, sf).select("drv_path", "license_kind", F.posexplode("licenses").alias("pos", "l"))
    return one.select(
        "drv_path", "license_kind", "pos", F.col("l.shortName").alias("short_name"), F.col("l.fullName").alias("full_name"),
        F.col("l.free").alias("free"), F.col("l.redistributable").alias("redistributable"),
    )


@query
def platforms_norm(spark, sf):
    """Platforms and outputs."""
    return clean_packages(spark, sf).select(
        "drv_path", joined(F.col("platforms")).alias("platforms"), joined(F.col("outputs_to_install")).alias("outputs_to_install")
    )


@query
def maintainer_norm(spark, sf):
    """One row per maintainer of every variant."""
    one = clean_packages(spark, sf).select("drv_path", F.explode("maintainers").alias("m"))
    return one.select("drv_path", "m.name", "m.email", "m.github", F.col("m.githubId").alias("github_id"))


@query
def flags(spark, sf):
    """Status flags."""
    return clean_packages(spark, sf).select("drv_path", "broken", "unfree", "insecure", "unsupported", "available")


@query
def map_snapshot(spark, sf):
    """A2: the map-shaped snapshot, an object of packages per order."""
    facts = D.variant_facts(spark, sf).where(F.col("attr_path") != "")
    entry = F.concat(
        F.lit('"'), "attr_path", F.lit("/"), "drv_path", F.lit('":{"description":"top","license":"L1","broken":true'),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(',"pname":"n'), "l_partkey", F.lit('"'))).otherwise(""),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(',"version":"'), "p_size", F.lit('"'))).otherwise(""),
        F.when(F.col("l_partkey") % 5 == 0, F.lit(',"meta":{"description":"inner","license":"","broken":false}')).otherwise(""),
        F.lit("}"),
    )
    objects = facts.groupBy("l_orderkey").agg(F.concat_ws(",", F.collect_list(entry)).alias("entries"))
    values = objects.select(F.concat(F.lit("{"), "entries", F.lit("}")).alias("value"))
    clean = normalize_map(explode_map(values), D.RUN_TS)
    return clean.select(
        "attribute_path", "package_name", "version", "description", F.col("licenses")[0]["shortName"].alias("license"), "broken"
    )


@query
def snapshot_lines(spark, sf):
    """A1: header, records, blank and broken lines of a snapshot told apart."""
    event = F.col("event_id")
    line = (
        F.when(event == 0, '{"_metadata":{"nixpkgs_branch":"main","total_packages":7}}')
        .when(event % 10 == 1, F.concat(F.lit('{"name":"p-'), "event_id"))
        .when(event % 10 == 2, "  ")
        .otherwise(F.concat(F.lit('{"name":"p-'), "event_id", F.lit('","meta":'), "props", F.lit("}")))
    )
    from cratewise.sources.snapshot import parse_lines

    parts = parse_lines(D.table(spark, sf, "events").select(line.alias("value")))
    return (
        parts.records.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("records"))
        .unionByName(parts.bad.agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit("bad")))
        .unionByName(parts.header.select(F.col("total_packages").alias("rows"), F.lit("header").alias("part")))
    )


# --- merge and star schema ------------------------------------------------------------------------


def stored_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized variants, stored because the catalog reads them several times."""
    return materialize(clean_packages(spark, sf_dir), "packages").df


@query
def merge_variants(spark, sf):
    """One package out of its variants."""
    m = M.merge_variants(stored_packages(spark, sf))
    people = F.transform("maintainers", lambda p: F.concat_ws("/", p["name"], p["email"], p["github"], p["githubId"].cast("string")))
    return m.select(
        "package_id", "package_name", "version", "attribute_path", "description", "homepage", "category", "main_program",
        F.coalesce("license_kind", F.lit("")).alias("license_kind"),
        joined(F.col("licenses.shortName")).alias("licenses"), joined(F.col("platforms")).alias("platforms"),
        joined(people).alias("maintainers"), "broken", "unfree", "insecure", "unsupported", "available",
    )


@query
def dim_license(spark, sf):
    """The license lookup."""
    return R.with_key(R.license_lookup(clean_packages(spark, sf)), ["short_name"], "license_id")


@query
def dim_arch(spark, sf):
    """The architecture lookup."""
    return R.with_key(R.architecture_lookup(clean_packages(spark, sf)), ["name"], "arch_id")


@query
def dim_maintainer(spark, sf):
    """The maintainer lookup."""
    return R.with_key(R.maintainer_lookup(clean_packages(spark, sf)), M.MAINTAINER_KEY, "maintainer_id")


@query
def bridge_license(spark, sf):
    """D3: package-license links, by short name."""
    packages = stored_packages(spark, sf)
    lookup = materialize(R.with_key(R.license_lookup(packages), ["short_name"], "license_id"), "licenses").df
    return R.license_links(M.merge_variants(packages), lookup).join(lookup, "license_id").select("package_id", "short_name")


@query
def bridge_arch(spark, sf):
    """Package-architecture links, by name."""
    packages = stored_packages(spark, sf)
    lookup = materialize(R.with_key(R.architecture_lookup(packages), ["name"], "arch_id"), "archs").df
    return R.architecture_links(M.merge_variants(packages), lookup).join(lookup, "arch_id").select("package_id", "name")


def _maintainer_bridge(spark: SparkSession, sf_dir: str, match: str) -> DataFrame:
    packages = stored_packages(spark, sf_dir)
    lookup = materialize(R.with_key(R.maintainer_lookup(packages), M.MAINTAINER_KEY, "maintainer_id"), "people").df
    links = R.maintainer_links(M.merge_variants(packages), lookup, match)
    return links.join(lookup, "maintainer_id").select("package_id", "name", "email", "github")


@query
def bridge_maintainer_exact(spark, sf):
    """Package-maintainer links on the whole key."""
    return _maintainer_bridge(spark, sf, "exact")


@query
def bridge_maintainer_any(spark, sf):
    """Package-maintainer links on any one filled field."""
    return _maintainer_bridge(spark, sf, "any")


@query
def variations(spark, sf):
    """One row per package and system."""
    return M.variations(clean_packages(spark, sf))


@query
def package_table(spark, sf):
    """The package rows of the star schema."""
    return R.package_table(M.merge_variants(stored_packages(spark, sf))).drop("content_hash")


def _flat_documents(catalog: R.Catalog) -> DataFrame:
    docs = L.catalog_documents(catalog)
    people = F.transform("maintainers", lambda p: F.concat_ws("/", p["name"], p["email"], p["github"], p["githubId"].cast("string")))
    return docs.select(
        "package_id",
        F.coalesce(F.col("license.type"), F.lit("")).alias("license_type"),
        F.coalesce(F.col("license.shortName"), joined(F.col("license.licenses.shortName"))).alias("licenses"),
        joined(people).alias("maintainers"),
        joined(F.col("platforms")).alias("platforms"),
        joined(F.col("outputs_to_install")).alias("outputs_to_install"),
    )


@query
def denormalized(spark, sf):
    """Documents rebuilt from the star schema."""
    return _flat_documents(R.build_catalog(stored_packages(spark, sf)))


def refreshed(spark: SparkSession, sf_dir: str) -> tuple[R.Catalog, H.Change]:
    """A catalog of another snapshot brought to the given one: orders added, changed and gone."""
    packages = stored_packages(spark, sf_dir)
    order = F.regexp_extract("drv_path", r"^/store/(\d+)-", 1).cast("bigint") % 20011
    earlier = packages.where(order != 7).withColumn("description", F.when(order == 9, F.concat(F.lit("Before "), "description")).otherwise(F.col("description")))
    gone = packages.where(order == 11).withColumn("package_id", F.concat(F.lit("old-"), "package_id"))
    path = _output(spark, "refreshed")
    H.write_parted(materialize(earlier.unionByName(gone), "earlier").df, path, digits=1)
    change = H.refresh_parted(packages, path, 0, digits=1)
    return L.read_catalog(spark, path), change


@query
def refreshed_packages(spark, sf):
    """The package table after a refresh by change."""
    return refreshed(spark, sf)[0].packages.drop("content_hash", "part")


@query
def refreshed_documents(spark, sf):
    """Documents rebuilt from a catalog after a refresh by change."""
    return _flat_documents(refreshed(spark, sf)[0])


@query
def refresh_counts(spark, sf):
    """A4: what a refresh by change found and left alone."""
    change = refreshed(spark, sf)[1]
    return spark.createDataFrame([(change.changed, change.removed, change.touched, change.untouched)], "changed bigint, removed bigint, touched bigint, untouched bigint")


@query
def coverage(spark, sf):
    """Packages with a license, maintainers, platforms."""
    return Q.coverage(L.catalog_documents(R.build_catalog(stored_packages(spark, sf))))


@query
def integrity(spark, sf):
    """Q3: violations of keys and references, all zero."""
    return Q.key_violations(R.build_catalog(stored_packages(spark, sf)))


# --- documents --------------------------------------------------------------------------------------


def record_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages whose node ids are those of the part graph."""
    edges, nodes = partner_graph(spark, sf_dir)
    packages = stored_packages(spark, sf_dir)
    by_part = packages.withColumns(
        {"package_name": F.lit("p"), "version": F.regexp_extract("drv_path", r"-(\d+)-\d+\.drv$", 1)}
    )
    named = [F.concat(F.lit("p-"), c).alias(c) for c in ["src", "dst"]]
    return by_part, edges.select(*named), nodes.select(F.concat(F.lit("p-"), "node_id").alias("node_id"))


@query
def node_documents(spark, sf):
    """Node documents, read back from their JSON."""
    packages, edges, nodes = record_graph(spark, sf)
    docs = O.node_documents(packages, G.dependency_facts(edges, nodes, B.reach_pairs(edges, nodes)), "t0", "main")
    doc = F.try_parse_json("doc")

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, f"$.{path}", kind)

    return docs.select(
        "node_id",
        get("nodeId", "string").alias("id_in_doc"),
        get("attributePath", "string").alias("attribute_path"),
        get("license.type", "string").alias("license_type"),
        get("license.value", "string").alias("license_value"),
        get("dependencies.count", "int").alias("dependencies"),
        get("dependencies.totalCount", "int").alias("all_dependencies"),
        get("dependents.count", "int").alias("dependents"),
        get("dependents.totalCount", "int").alias("all_dependents"),
        joined(get("dependencies.direct", "array<string>")).alias("direct"),
        get("nodeMetadata.hasDependents", "boolean").alias("has_dependents"),
        get("nodeMetadata.nixpkgsBranch", "string").alias("branch"),
    )


@query
def index_slim(spark, sf):
    """The slim list of the index document."""
    return O.index_rows(M.merge_variants(stored_packages(spark, sf)))


@query
def store_documents(spark, sf):
    """Stored documents decoded again."""
    merged = M.merge_variants(stored_packages(spark, sf))
    docs = merged.withColumns({"license": O.typed_license(F.col("license_kind"), F.col("licenses")), "content_hash": R.content_hash(merged)})
    decoded = O.decode_documents(O.store_documents(docs))
    return decoded.select(
        "package_id", "package_name", "version", "description", "homepage", "category", "broken", "unfree", "available",
        joined(F.col("platforms")).alias("platforms"), joined(F.col("outputs_to_install")).alias("outputs_to_install"),
        P.license_display(F.col("license")).alias("license_name"), "main_program", "last_updated", "is_stub",
    )


@query
def fetch_documents(spark, sf):
    """Documents by id, with stubs for ids the store lacks."""
    store = D.table(spark, sf, "documents").where(F.col("source") != "src3").select(
        F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct(F.col("lang").alias("category"))).alias("doc")
    )
    asked = D.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return O.decode_documents(O.fetch_documents(store, asked)).select("id", "category", "available", "is_stub")


@query
def sample_docs(spark, sf):
    """A uniform sample without replacement."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    return O.sample_documents(docs, SAMPLE_SIZE, seed=7)


@query
def storage_stats(spark, sf):
    """Raw bytes of the stored documents against the length column's share of them."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("doc"), "n_chars")
    stored = docs.agg((F.sum("n_chars") / 4).cast("bigint").alias("n")).scalar()
    stats = Q.storage_stats(docs, stored)
    return stats.withColumn("saving_percent", rounded(F.col("saving_percent"), 4))


@query
def roundtrip(spark, sf):
    """Q5: documents written as a store and read again, differences only (none)."""
    docs = D.corpus(spark, sf).select("id", F.to_json(F.struct("id", "name", "description")).alias("doc"))
    again = materialize(docs, "store").df
    return Q.round_trip_differences(docs, again)


def _store_written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The corpus as store documents, and where they have been written."""
    docs = D.corpus(spark, sf_dir).select(
        "id", F.to_json(F.struct(F.col("id").alias("package_id"), F.col("name").alias("package_name"), "description", "category")).alias("doc")
    )
    path = _output(spark, "store")
    O.write_document_store(docs, path)
    return docs, path


@query
def store_written(spark, sf):
    """A store on disk: what came back, what decodes, and whether it is smaller than its documents."""
    docs, path = _store_written(spark, sf)
    again = spark.read.parquet(path)
    differing = Q.round_trip_differences(docs, again).select(F.count(F.lit(1))).scalar()
    stubs = O.decode_documents(again).select(F.count_if("is_stub")).scalar()
    stats = Q.storage_stats(again, Q.folder_bytes(spark, path))
    saves = (F.col("stored_bytes") > 0) & (F.col("stored_bytes") < F.col("raw_bytes"))
    return stats.select("total_documents", differing.alias("differing"), stubs.alias("stubs"), saves.alias("saves"))


@query
def output_check(spark, sf):
    """Q2: tables present, a document decodes, index and store agree."""
    text_index(spark, sf)
    _, path = _store_written(spark, sf)
    found = Q.verify_output(spark, path, WRITTEN[spark.sparkContext.applicationId, sf])
    return spark.createDataFrame(sorted(found.items()), "check string, good boolean")


@query
def write_counts(spark, sf):
    """Q4: documents written and left out, counted by the write itself."""
    docs = D.corpus(spark, sf).select("id", F.col("description").alias("doc"), "category")
    valid, seen = Q.count_writes(docs, F.col("category") != "fr")
    path = _output(spark, "valid")
    valid.write.parquet(path)
    counts = [F.lit(seen.get[c]).cast("bigint").alias(c) for c in ["success", "errors", "total"]]
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored")).select("stored", *counts)


@query
def snapshot_written(spark, sf):
    """A3, A1: a snapshot written with its header and read again."""
    path = _output(spark, "snapshot")
    lines = D.record_lines(D.variant_facts(spark, sf))
    manifest = write_snapshot(lines, path, "main", D.RUN_TS)
    again = read_snapshot(spark, f"{path}/*")
    header = again.header.select("total_packages").scalar()
    counts = again.records.agg(F.count(F.lit(1)).alias("records"))
    bad = again.bad.select(F.count(F.lit(1))).scalar()
    saves = manifest.select((F.col("stored_bytes") > 0) & (F.col("stored_bytes") < F.col("raw_bytes"))).scalar()
    return counts.select("records", header.alias("in_header"), bad.alias("bad"), saves.alias("saves"))


@query
def catalog_written(spark, sf):
    """A4, A5, Q3: the star schema on disk, read back with faults put in: packages twice, a license gone."""
    path = _output(spark, "catalog")
    L.write_catalog(R.build_catalog(stored_packages(spark, sf)), path)
    good = L.read_catalog(spark, path)
    twice = good.packages.unionByName(good.packages.where("broken"))
    licenses = good.licenses.where("short_name <> 'MIT'").unionByName(good.licenses.where("short_name LIKE 'Brand#1%'"))
    return Q.key_violations(replace(good, packages=twice, licenses=licenses)).where("violations > 0")


@query
def index_store_match(spark, sf):
    """Q1: the index and a store that lacks some documents."""
    store = D.corpus(spark, sf).where(F.col("category") != "fr").select("id")
    return Q.index_matches_store(text_index(spark, sf).docs, store)


@query
def stats_document(spark, sf):
    """The statistics document."""
    summary = G.degree_summary(G.degrees(D.part_edges(spark, sf), D.part_nodes(spark, sf)))
    doc = O.stats_document(summary, {"nixpkgs_branch": "main"}).select(F.try_parse_json("value").alias("v"))
    return doc.select(
        F.try_variant_get("v", "$.metadata.nixpkgs_branch", "string").alias("branch"),
        F.try_variant_get("v", "$.stats.total_packages", "bigint").alias("total_packages"),
        F.try_variant_get("v", "$.stats.max_dependents", "bigint").alias("max_dependents"),
    )


# --- presentation and requests ----------------------------------------------------------------------


@query
def license_family(spark, sf):
    """License families over part names as licenses."""
    words = F.array(*[F.lit(w) for w in ["MIT", "BSD-3", "LGPL-2", "Apache-2.0", "Zlib", "Summit"]])
    first = F.element_at(words, (F.col("p_partkey") % 6 + 1).cast("int"))
    second = F.element_at(words, (F.col("p_size") % 6 + 1).cast("int"))
    return D.table(spark, sf, "part").select("p_partkey", P.license_family(F.array(first, second)).alias("family"))


def _license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    text = (
        F.when(part % 5 == 0, F.concat(F.lit('{"shortName":"'), "p_brand", F.lit('","free":true}')))
        .when(part % 5 == 1, F.concat(F.lit('{"shortName":"'), "p_brand", F.lit('","free":false}')))
        .when(part % 5 == 2, '{"fullName":"x"}')
        .when(part % 5 == 3, "null")
        .otherwise("{broken")
    )
    return D.table(spark, sf_dir, "part").select("p_partkey", text.alias("license"))


@query
def license_display(spark, sf):
    """Shown license name and freedom."""
    lic = F.col("license")
    return _license_texts(spark, sf).select("p_partkey", P.license_display(lic).alias("name"), P.is_free(lic).alias("is_free"))


@query
def enriched_results(spark, sf):
    """Results with license list, unfree flag and defaults."""
    rows = _license_texts(spark, sf).select(
        "p_partkey", "license", F.when(F.col("p_partkey") % 2 == 0, "tools").alias("category"),
        F.lit(None).cast("array<string>").alias("maintainers"), F.lit(None).cast("array<string>").alias("platforms"),
        F.when(F.col("p_partkey") % 3 == 0, True).alias("broken"),
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "nixpkgs.").otherwise("other."), F.lit("p"), "p_partkey").alias("attribute_path"),
    )
    return P.enrich_results(rows).select(
        "p_partkey", joined(F.col("license_list")).alias("license_list"), "unfree", "category", "broken",
        F.size("maintainers").alias("n_maintainers"), T.display_name(F.col("attribute_path")).alias("display_name"),
    )


@query
def result_envelope(spark, sf):
    """Search hits as JSON, optional fields left out when null."""
    rows = D.table(spark, sf, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("package_id"), F.col("p_name").alias("package_name"),
        F.when(F.col("p_size") > 20, F.col("p_brand")).alias("main_program"), (F.col("p_size") % 2 == 0).alias("broken"),
    )
    return rows.select("package_id", P.result_json(rows.columns).alias("json"))


@query
def search_answers(spark, sf):
    """Whole answers with all 19 fields of their packages, one per order."""
    orders, lines = D.table(spark, sf, "orders"), D.table(spark, sf, "lineitem").join(D.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    requests = orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("query"), (F.col("o_orderkey") % 40 / 4).alias("query_time_ms"))
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    found = lines.where("l_quantity >= 25").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("total_count"),
        F.concat(F.lit("p"), key).alias("package_id"), F.col("p_name").alias("package_name"), size.cast("string").alias("version"),
        F.when(size > 25, F.concat(F.lit('A "'), "p_type", F.lit('"'))).alias("description"), F.when(size % 2 == 0, F.concat(F.lit("https://e.org/"), key)).alias("homepage"),
        F.col("p_brand").alias("license"), F.concat(F.lit("pkgs.p"), key).alias("attribute_path"), F.when(size % 3 == 0, "tools").alias("category"),
        (F.col("l_returnflag") == "R").alias("broken"), (F.col("l_linenumber") == 2).alias("unfree"), F.lit(True).alias("available"), (F.col("l_quantity").cast("int") / 4).alias("relevance_score"),
        F.when(size % 5 == 0, F.array(F.struct(F.col("p_brand").alias("name")))).alias("maintainers"), F.when(size % 7 == 0, F.array(F.lit("a-linux"), F.lit("b-linux"))).alias("platforms"),
        F.when(size % 4 == 1, F.lit("long")).alias("long_description"), F.when(size % 4 == 2, F.concat(F.lit("run-"), key)).alias("main_program"), F.when(size % 4 == 3, F.lit("f.nix:1")).alias("position"),
        F.when(size % 6 == 0, F.array(F.lit("out"))).alias("outputs_to_install"), F.when(size % 8 == 0, F.lit("2024")).alias("last_updated"),
    )
    return P.search_answers(requests, found.where("rank <= 3"))


@query
def list_caps(spark, sf):
    """lists and texts cut as publishers ask for: items first, then what is no item."""
    lines = D.table(spark, sf, "lineitem")
    name = F.concat(F.lit("s"), "l_suppkey")
    system = F.when(F.col("l_linenumber") % 3 == 0, F.lit('{"cpu":"x"}')).otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    person = F.when(F.col("l_linenumber") % 3 == 1, F.lit('{"name":""}')).otherwise(F.concat(F.lit('{"name":"'), name, F.lit('"}')))
    row = F.struct("l_linenumber", "l_suppkey", system.alias("system"), person.alias("person"))
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def parsed(member: str) -> Column:
        return F.try_parse_json(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r[member]), ","), F.lit("]")))

    typed = lists.select("l_orderkey", parsed("system").alias("systems"), parsed("person").alias("people"))
    platforms = V.platforms(F.col("systems"), V.kind(F.col("systems")), cap=3)
    people = V.maintainers(F.col("people"), V.kind(F.col("people")), cap=2)
    return typed.select("l_orderkey", joined(platforms).alias("platforms"), joined(F.transform(people, lambda m: m["name"])).alias("maintainers"))


@query
def request_params(spark, sf):
    """Typed request fields."""
    requests = D.search_requests(spark, sf)
    return requests.select("request_id", *[c.alias(n) for n, c in P.request_columns(F.col("params")).items()])


@query
def exact_slots(spark, sf):
    """Minute slots that break where a sequential reader's would, budgets small enough for many slots."""
    texts = D.table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return U.exact_slots(texts, ["doc_id"], F.col("tokens"), max_requests=7, max_tokens=4000)


@query
def token_estimate(spark, sf):
    """Token estimates."""
    return D.table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query
def rolling_quota(spark, sf):
    """Requests and tokens in the last minute of each user."""
    events = D.table(spark, sf, "events").select("event_id", "user_id", "ts", F.floor(F.col("value") * 100).alias("tokens"))
    used = U.rolling_usage(events, "user_id", "ts", F.col("tokens"), max_requests=1, max_tokens=5000)
    return used.select("event_id", "requests_in_minute", "tokens_in_minute", "over_budget")


@query
def rolling_quota_by_type(spark, sf):
    """W1 with few, hot keys: the last minute of each event type."""
    events = D.table(spark, sf, "events").select("event_id", "event_type", "ts", F.floor(F.col("value")).alias("tokens"))
    used = U.rolling_usage(events, "event_type", "ts", F.col("tokens"), max_requests=2, max_tokens=60)
    return used.select("event_id", "requests_in_minute", "tokens_in_minute", "over_budget")


@query
def rolling_quota_banded(spark, sf):
    """W1 by running totals: the last minute of each event type, without a partition by type."""
    events = D.table(spark, sf, "events").select("event_id", "event_type", "ts", F.floor(F.col("value")).alias("tokens"))
    used = U.banded_usage(events, "event_type", "ts", F.col("tokens"), max_requests=2, max_tokens=60)
    return used.select("event_id", "requests_in_minute", "tokens_in_minute", "over_budget")


@query
def batch_slots(spark, sf):
    """Minute slots for embedding requests, in document order."""
    texts = D.table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return U.batch_slots(texts, ["doc_id"], F.col("tokens")).select("doc_id", "cum_requests", "cum_tokens", "slot")
