"""Queries over whole workbooks, worksheets and graphs of calculations, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import calc as C
from ..operators import filters as X
from ..operators import graph as G
from ..operators import relationships as R
from ..operators import worksheet as W
from ..sources import workbook as B
from ..sources.shared import shared_folder
from .common import STAR, table

BOOK = """<workbook><datasources><datasource name='shop'><connection><named-connections><named-connection caption='shop'><connection class='textscan' filename='shop.csv'/></named-connection></named-connections>
<relation type='join' join='inner'><clause type='join'><expression op='='><expression op='[orders].[o_custkey]'/><expression op='[customer].[c_custkey]'/></expression></clause><relation type='table' name='orders' table='[Extract].[orders]'/><relation type='table' name='customer' table='[Extract].[customer]'/></relation>
<cols><map key='[o_totalprice]' value='[orders].[o_totalprice]'/><map key='[c_mktsegment]' value='[customer].[c_mktsegment]'/></cols></connection>
<column name='[o_totalprice]' datatype='real' role='measure'/><column name='[o_orderstatus]' datatype='string' role='dimension'/><column name='[c_mktsegment]' datatype='string' role='dimension'/><column name='[o_orderdate]' datatype='date' role='dimension'/>
<column name='[Calculation_1]' caption='Revenue' datatype='real' role='measure'><calculation formula='SUM([o_totalprice])'/></column><column name='[Calculation_2]' caption='Of customer' datatype='real' role='measure'><calculation formula='{FIXED [c_mktsegment] : SUM([o_totalprice])}'/></column>
<column name='[Calculation_3]' caption='So far' datatype='real' role='measure'><calculation formula='RUNNING_SUM(SUM([o_totalprice]))'/></column><column name='[Calculation_4]' caption='Price bin' datatype='integer' role='dimension'><calculation formula='INT([o_totalprice]/100)*100'/></column>
<hierarchy name='Market'><level field='[c_mktsegment]'/><level field='[o_orderstatus]'/></hierarchy><group name='[Open]' field='[o_orderstatus]'><member>O</member><member>P</member></group><set name='[Big]' field='[c_mktsegment]' condition='SUM([o_totalprice]) &gt; 10'/><bin field='[o_totalprice]' size='50'/>
<style><style-rule element='mark'><encoding attr='color' field='[o_orderstatus]'><map to='#ff0000'><bucket>"F"</bucket></map><map to='#00ff00'><bucket>"O"</bucket></map></encoding></style-rule></style></datasource>
<datasource name='Parameters'><column name='[Parameter 1]' caption='Top N' datatype='integer' param-domain-type='list' value='10'><members><member value='5'/><member value='10'/></members></column><column name='[Parameter 2]' caption='Kind' datatype='string' param-domain-type='list' value='a'><members><member value='a'/></members></column></datasource></datasources>
<datasource-relationships><datasource-relationship source='shop' target='targets'><column-mapping><map key='[shop].[none:c_mktsegment:nk]' value='[targets].[none:segment:nk]'/></column-mapping></datasource-relationship></datasource-relationships>
<actions><action caption='To detail' type='filter'><source-sheet-name>Sales</source-sheet-name><target-sheet-name>Trend</target-sheet-name><field>o_orderstatus</field></action></actions>
<worksheets><worksheet name='Sales'><table><rows>[shop].[sum:o_totalprice:qk]</rows><cols>[shop].[none:c_mktsegment:nk]</cols><panes><pane><encodings><color column='[shop].[none:o_orderstatus:nk]'/><text column='[shop].[usr:Calculation_3:qk]'/></encodings></pane></panes><style><style-rule element='cell'><format attr='text-format' field='[shop].[sum:o_totalprice:qk]' value='#,##0'/></style-rule></style></table><tooltip>Total of the segment</tooltip></worksheet>
<worksheet name='Trend'><table><rows>[shop].[usr:Calculation_1:qk]</rows><cols>[shop].[mn:o_orderdate:ok]</cols></table></worksheet></worksheets>
<dashboards><dashboard name='All'><size maxwidth='1280' maxheight='720'/><zones><zone name='Sales' x='0' y='0' w='640' h='720'/><zone name='Trend' x='640' y='0' w='640' h='720'/></zones><devicelayouts><devicelayout name='Phone'><zones><zone name='Sales' x='0' y='0' w='360' h='600'/></zones></devicelayout></devicelayouts></dashboard></dashboards>
<windows><window class='worksheet' name='Sales'><viewpoint><highlight><color-one-way><field>[shop].[none:o_orderstatus:nk]</field></color-one-way></highlight></viewpoint></window></windows></workbook>"""


def book(spark):
    """The workbook above, written as a file and read like any other."""
    path = f"{shared_folder(spark)}/book-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(BOOK.replace("\n", " "),)], "value string").coalesce(1).write.text(path)
    return B.workbook(spark, path)


def workbook_summary(spark, d):
    return B.model_summary(book(spark)).select("model_type", "cardinality", "tables", "joins", "fields", "worksheets", "dashboards", "lods", "table_calcs", "hierarchies", "groups", "sets", "bins", "parameters", "actions", "zones")


def workbook_calculations(spark, d):
    """Level-of-detail and table calculations with the tables that they draw on."""
    b = book(spark)
    return b["lods"].select("caption", "kind", F.array_join("source_tables", ",").alias("tables")).unionByName(b["table_calcs"].select("caption", F.col("function").alias("kind"), F.array_join("source_tables", ",").alias("tables")))


def workbook_hierarchy_run(spark, d):
    """The workbook's hierarchy, drilled over its joined tables."""
    levels = book(spark)["hierarchies"].first()["levels"]
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup(*levels).agg(F.count("*").alias("n"))


def workbook_groups_run(spark, d):
    """The workbook's group and bins as columns of the table."""
    b = book(spark)
    g, size = b["groups"].first(), {r["source"]: r["size"] for r in b["bins"].collect()}
    o = table(spark, d, "orders")
    return o.groupBy(X.group_of(F.col(g["field"]), {g["name"]: g["members"]}, "Other").alias("kind"), C.bin_of(F.col("o_totalprice"), size["calculation"] * 1000).cast("long").alias("low")).agg(F.count("*").alias("n"))


def workbook_suggested(spark, d):
    b = book(spark)
    return R.suggested(b["joins"], b["relationships"])


def workbook_everything(spark, d):
    """Rows of each kind over two copies of the workbook."""
    b = book(spark)
    books = {"a": b, "b": b}
    out = None
    for kind in ("tables", "fields", "worksheets", "zones", "shelves"):
        made = B.all_of_kind(books, kind).groupBy("workbook").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = made if out is None else out.unionByName(made)
    return out


def parameter_kinds(spark, d):
    p = book(spark)["parameters"]
    return p.select("name", X.numeric_parameter(F.col("datatype"), F.col("domain"), F.col("members")).alias("numeric"))


def sheet_fields(spark, d):
    b = book(spark)
    return W.resolved(b["shelves"], b["fields"]).select("worksheet", F.col("place").cast("long").alias("place"), "name", "kind")


def sheet_charts(spark, d):
    b = book(spark)
    return W.chart_types(b["shelves"], b["fields"])


def sheet_run(spark, d):
    """A worksheet as it resolves: its dimensions and base measures over the joined tables."""
    b = book(spark)
    r = [x for x in W.resolved(b["shelves"], b["fields"]).where("worksheet = 'Sales'").collect()]
    dims, measures = sorted(x["name"] for x in r if x["kind"] == "dimension"), {x["name"]: F.round(F.sum(x["name"]), 2) for x in r if x["kind"] == "measure"}
    return W.run(B.joined_tables({t: table(spark, d, t) for t in ("orders", "customer")}, b["joins"]), dims, measures)


def sheet_context(spark, d):
    """Where calculations are shown, how, and what they restart at."""
    b = book(spark)
    r = W.resolved(b["shelves"], b["fields"])
    c = W.visual_context(W.addressing(r), W.chart_types(b["shelves"], b["fields"]))
    dated = W.needs_date_table(F.col("partition"), F.array(F.lit("o_orderdate")))
    return c.select("calculation", F.array_join("worksheets", ",").alias("worksheets"), F.array_join("charts", ",").alias("charts"), F.array_join("partition", ",").alias("partition"), dated.alias("needs_date_table"))


def _calcs(spark):
    return book(spark)["fields"].where("formula is not null").select(F.coalesce("caption", "name").alias("name"), "formula").unionByName(spark.createDataFrame([("Share", "[Revenue] / [Of customer]"), ("Odd", "[nowhere] + 1")], "name string, formula string"))


def graph_dependencies(spark, d):
    cols = spark.createDataFrame([(c,) for t in STAR for c in table(spark, d, t).columns], "column string")
    return G.dependency_kinds(_calcs(spark), cols)


def graph_dependents(spark, d):
    return G.dependents(_calcs(spark))


def graph_roots(spark, d):
    return G.roots(_calcs(spark))


QUERIES = {
    f.__name__: f
    for f in (
        workbook_summary, workbook_calculations, workbook_hierarchy_run, workbook_groups_run, workbook_suggested, workbook_everything, parameter_kinds, sheet_fields, sheet_charts, sheet_run, sheet_context, graph_dependencies, graph_dependents, graph_roots,
    )
}

_TEXT = BOOK.replace("\n", " ").replace("'", "''")
_N = lambda p: f"len(regexp_extract_all(b, '{p}'))"
_BOOK = f"WITH w AS (SELECT '{_TEXT}' AS b)"
_CALCS = f"{_BOOK}, f AS (SELECT unnest(regexp_extract_all(b, 'caption=''([^'']*)'' datatype=''[a-z]*'' role=''[a-z]*''><calculation', 1)) AS name, unnest(regexp_extract_all(b, '<calculation formula=''([^'']*)''', 1)) AS formula FROM w UNION ALL VALUES ('Share', '[Revenue] / [Of customer]'), ('Odd', '[nowhere] + 1')), e AS (SELECT DISTINCT name, unnest(regexp_extract_all(formula, '\\[([^\\]]+)\\]', 1)) AS source, formula FROM f)"
_COLUMNS = " UNION ".join(f"SELECT column_name AS c FROM (DESCRIBE {t})" for t in STAR)

ORACLE_SQL = {
    "workbook_summary": f"{_BOOK} SELECT 'JOIN' AS model_type, 'many-to-one' AS cardinality, " + ", ".join(f"{_N(p)}::BIGINT AS {k}" for k, p in {
        "tables": "<relation type=''table''", "joins": "<relation type=''join''", "fields": "<column name=", "worksheets": "<worksheet name=", "dashboards": "<dashboard name=", "lods": "formula=''\\{FIXED", "table_calcs": "formula=''RUNNING_", "hierarchies": "<hierarchy ", "groups": "<group ",
        "sets": "<set ", "parameters": "param-domain-type=", "actions": "<action ", "zones": "<zone name="}.items()) + f", ({_N('<bin ')} + {_N("formula=''INT")})::BIGINT AS bins FROM w",
    "workbook_hierarchy_run": "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)",
    "workbook_groups_run": "SELECT CASE WHEN o_orderstatus IN ('O', 'P') THEN 'Open' ELSE 'Other' END AS kind, CAST(floor(o_totalprice / 100000) * 100000 AS BIGINT) AS low, count(*) AS n FROM orders GROUP BY 1, 2",
    "workbook_suggested": f"{_BOOK}, x AS (SELECT regexp_extract_all(b, '<expression op=''\\[([a-z]+)\\]\\.\\[[a-z_]+\\]''/>', 1) AS t, regexp_extract_all(b, '<expression op=''\\[[a-z]+\\]\\.\\[([a-z_]+)\\]''/>', 1) AS c FROM w) SELECT t[1] AS source_table, c[1] AS source_column, t[2] AS target_table, c[2] AS target_column, 'WORKBOOK' AS detection_method FROM x",
    "workbook_everything": f"{_BOOK}, n AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {_N(p)}::BIGINT AS n FROM w" for k, p in {"tables": "<relation type=''table''", "fields": "<column name=", "worksheets": "<worksheet name=", "zones": "<zone name=", "shelves": "(?:<rows>\\[|<cols>\\[|<color column|<text column)"}.items()) + ") SELECT workbook, kind, n FROM n, (VALUES ('a'), ('b')) v(workbook)",
    "parameter_kinds": f"{_BOOK} SELECT unnest(regexp_extract_all(b, 'caption=''([^'']*)'' datatype=''[a-z]*'' param', 1)) AS name, unnest(regexp_extract_all(b, 'datatype=''([a-z]*)'' param', 1)) = 'integer' AS numeric FROM w",
    "sheet_run": "SELECT c_mktsegment, o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "graph_dependencies": f"{_CALCS} SELECT name, source, CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.name = e.source AND g.formula LIKE 'SUM%') THEN 'CALCULATED_MEASURE' WHEN EXISTS (SELECT 1 FROM f g WHERE g.name = e.source) THEN 'CALCULATED_COLUMN' WHEN source IN ({_COLUMNS}) THEN 'BASE_COLUMN' ELSE 'UNKNOWN' END AS kind, EXISTS (SELECT 1 FROM f g WHERE g.name = e.source AND g.formula LIKE 'SUM%') AS aggregated FROM e",
    "graph_dependents": f"{_CALCS} SELECT source AS name, count(*) AS n, string_agg(name, ',' ORDER BY name) AS dependents FROM e GROUP BY 1",
    "graph_roots": f"{_CALCS} SELECT name FROM f WHERE NOT EXISTS (SELECT 1 FROM e JOIN f g ON g.name = e.source WHERE e.name = f.name)",
}
