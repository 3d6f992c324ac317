"""Where columns come from: edges read from analysed plans, closures in SQL, versions.

Nobody declares anything: the plan of a table says which columns each of its
columns is computed from. An edge leads from an input to what is made of it;
columns of a scan or of rows made on the spot are sources. Functions
in Python are opaque, so what they return depends on all they are given; filters, groups,
join conditions and sort orders choose rows and are no edges.

Edges, versions and what changed are tables, so ancestors are a recursive
query and differences of versions are joins.

Edge cases: a column that is handed through keeps its identity, however often it
is renamed; names that clash are told apart by their identity; a constant
has no ancestor; a plan without columns gives no edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

EDGES = "version string, source string, target string, step string"
NODES = "version string, node string, name string, kind string, made string"


@dataclass(frozen=True)
class Read:
    """What a plan says: nodes by identity (name, kind, expression) and edges."""

    nodes: dict[str, tuple[str, str, str]]
    edges: list[tuple[str, str, str]]
    outputs: list[str]


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _key(attribute) -> str:
    return f"{attribute.name()}#{attribute.exprId().id()}"


def read_plan(df: DataFrame) -> Read:
    """Nodes and edges of the analysed plan of ``df``."""
    nodes: dict[str, tuple[str, str, str]] = {}
    edges: list[tuple[str, str, str]] = []
    name_of: dict[int, str] = {}

    def key(attribute) -> str:
        return name_of.setdefault(attribute.exprId().id(), _key(attribute))

    def named(expressions) -> dict[int, object]:
        """Expressions with an identity of their own, by it."""
        out = {}
        for e in expressions:
            if e.getClass().getSimpleName() in ("Alias",):
                out[e.exprId().id()] = e
        return out

    def walk(plan) -> None:
        children = _list(plan.children())
        for c in children:
            walk(c)
        kind, given = plan.nodeName(), [a for c in children for a in _list(c.output())]
        have = {a.exprId().id() for a in given}
        made = named(_list(plan.expressions()))
        for i, a in enumerate(_list(plan.output())):
            if a.exprId().id() in have and kind != "Union":
                continue
            target = key(a)
            if not children:
                nodes.setdefault(target, (a.name(), "source", kind))
            elif kind == "Union":
                for c in children:
                    source = key(c.output().apply(i))
                    if source != target:
                        nodes.setdefault(target, (a.name(), "made", kind))
                        edges.append((source, target, kind))
            else:
                e = made.get(a.exprId().id())
                sources = _list(e.references().toSeq()) if e is not None else given
                nodes.setdefault(target, (a.name(), "made", e.child().toString() if e is not None else kind))
                edges.extend((key(s), target, kind) for s in sources)

    plan = df._jdf.queryExecution().analyzed()
    walk(plan)
    return Read(nodes, list(dict.fromkeys(edges)), [key(a) for a in _list(plan.output())])


class Store:
    """Versions of a table's lineage, kept as two tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.order = spark, []
        self.edges: list[tuple[str, str, str, str]] = []
        self.nodes: list[tuple[str, str, str, str, str]] = []

    def add(self, version: str, df: DataFrame) -> Read:
        if version in self.order:
            raise ValueError(f"version {version} is there already")
        found = read_plan(df)
        self.order.append(version)
        self.edges += [(version, *e) for e in found.edges]
        self.nodes += [(version, k, *found.nodes.get(k, (k.rpartition("#")[0], "source", ""))) for k in dict.fromkeys([*found.nodes, *found.outputs])]
        self.nodes += [(version, k, k.rpartition("#")[0], "output", str(i)) for i, k in enumerate(found.outputs)]
        return found

    def views(self) -> None:
        self.spark.createDataFrame(self.edges, EDGES).createOrReplaceTempView("lineage_edges")
        self.spark.createDataFrame(self.nodes, NODES).createOrReplaceTempView("lineage_nodes")

    def ancestors(self) -> DataFrame:
        """``version, feature, source``: all sources that a version's output columns come from."""
        self.views()
        return self.spark.sql("""
            with recursive up(version, feature, node) max recursion level 500 as (
                select version, name, node from lineage_nodes where kind = 'output'
                union all
                select u.version, u.feature, e.source from up u join lineage_edges e on e.version = u.version and e.target = u.node
            )
            select distinct u.version, u.feature, n.name as source from up u
            join lineage_nodes n on n.version = u.version and n.node = u.node and n.kind = 'source'""")

    def descendants(self, version: str, source: str) -> DataFrame:
        """``feature``: output columns that would change with a source."""
        found = self.ancestors()
        return found.where((found["version"] == version) & (found["source"] == source)).select("feature").distinct()

    def changes(self, old: str, new: str) -> DataFrame:
        """``feature, change``: output columns that one version lacks, whose
        sources differ, or that are computed otherwise."""
        self.views()
        self.ancestors().createOrReplaceTempView("lineage_ancestors")
        # What a column is computed by, whatever the identities in this session.
        return self.spark.sql(f"""
            with recursive up(version, feature, node) max recursion level 500 as (
                select version, name, node from lineage_nodes where kind = 'output' and version in ('{old}', '{new}')
                union all
                select u.version, u.feature, e.source from up u join lineage_edges e on e.version = u.version and e.target = u.node
            ),
            made as (
                select u.version, u.feature, array_sort(collect_set(regexp_replace(n.made, '#[0-9]+L?', ''))) as how from up u
                join lineage_nodes n on n.version = u.version and n.node = u.node and n.kind = 'made' group by all
            ),
            every as (
                select n.version, n.name as feature, coalesce(m.how, array()) as how, coalesce(s.sources, array()) as sources from lineage_nodes n
                left join made m on m.version = n.version and m.feature = n.name
                left join (select version, feature, array_sort(collect_set(source)) as sources from lineage_ancestors group by all) s on s.version = n.version and s.feature = n.name
                where n.kind = 'output'
            ),
            a as (select * from every where version = '{old}'), b as (select * from every where version = '{new}')
            select coalesce(a.feature, b.feature) as feature,
                case when a.feature is null then 'added' when b.feature is null then 'removed' when a.sources <> b.sources then 'sources' else 'expression' end as change
            from a full join b on a.feature = b.feature
            where a.feature is null or b.feature is null or a.sources <> b.sources or a.how <> b.how""")
