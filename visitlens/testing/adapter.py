"""Stand-in inputs built from the driver's star-schema tables.

The adapter only produces rows in the *raw* schema the library reads — text
cells under the sheet's headers, as an export would deliver them.  It does
none of the library's work: parsing, defaults, splitting, counting and
normalising all happen in ``visitlens`` on these rows.  The same rows are
produced by ``visitlens.testing.oracle_sql`` in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Segment labels assigned to lines by ``l_partkey % 6`` (RODILLA is not in the
# anatomical order list, so it exercises the "unknown last" rule).
FIXTURE_SEGMENTS = ["HOMBRO_DER", "CODO_IZQ", "MANO_DER", "CERVICAL", "LUMBAR", "RODILLA"]


_FRAMES: dict[tuple, tuple[SparkSession, DataFrame]] = {}


def _memo(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Reuse the (lazy, immutable) DataFrame object of an input within one
    session: the plan is built and analysed once, every action still reads
    and computes everything.  Nothing is cached as data.  The session is
    held with the frame, so a later session never gets a stale plan."""
    hit = _FRAMES.get(key)
    if hit is None or hit[0] is not spark:
        hit = (spark, build())
        _FRAMES[key] = hit
    return hit[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _memo(spark, ("table", sf_dir, name), lambda: _table(spark, sf_dir, name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c):
    return c.cast("string")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    w1 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    w2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    k5 = F.col("p_partkey") % 5
    dirty = (F.when(k5 == 0, F.col("p_name"))
              .when(k5 == 1, F.concat(F.upper("p_name"), F.lit("S")))
              .when(k5 == 2, F.translate("p_name", "aeo", "áéó"))
              .when(k5 == 3, F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")), F.lit(" ")))
              .otherwise(F.concat(w2, F.lit(" "), w1)))
    occ = F.concat(F.upper("p_type"), F.lit(" "), F.upper(w2))
    occ_dirty = (F.when(k5 == 0, F.concat(F.lower(occ), F.lit("s"))).when(k5 == 1, F.concat(F.upper(w2), F.lit(" "), F.upper("p_type")))
                 .when(k5 == 2, F.concat(occ, F.lit(" A"))).otherwise(occ))
    seg = F.element_at(F.array(*[F.lit(s) for s in FIXTURE_SEGMENTS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    # a part's texts are made once, not for each of its lines
    part = part.select("p_partkey", occ.alias("occ"), occ_dirty.alias("occ_dirty"), F.col("p_name").alias("task"), dirty.alias("task_dirty"),
                       F.col("p_brand").alias("diag"), seg.alias("seg"))
    folio = F.concat(F.lit("F"), _s(F.col("l_orderkey") % 500), F.lit("-"), _s(F.col("l_suppkey") % 3))
    lines = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
             .select("l_orderkey", folio.alias("folio"), "occ", "occ_dirty", "task", "task_dirty", "diag", "seg"))

    def agg_sorted(c, sep):
        return F.array_join(F.sort_array(F.collect_list(c)), sep)

    # one shuffle: hash-partitioning on the order key satisfies both grouping
    # levels (order, case) and (order), and the later join on the order key
    lines = lines.repartition("l_orderkey")
    per_case = lines.groupBy("l_orderkey", "folio").agg(
        agg_sorted("occ", " | ").alias("occ"), agg_sorted("occ_dirty", " | ").alias("occ_dirty"), agg_sorted("task", ", ").alias("task"),
        agg_sorted("task_dirty", ", ").alias("task_dirty"), agg_sorted("diag", ", ").alias("diag"),
        agg_sorted("seg", " ").alias("seg"))
    return per_case.groupBy("l_orderkey").agg(
        agg_sorted("folio", " || ").alias("case_ids"), agg_sorted("occ", " || ").alias("occupations"),
        agg_sorted("occ_dirty", " || ").alias("occupations_dirty"),
        agg_sorted("task", " || ").alias("tasks"), agg_sorted("task_dirty", " || ").alias("tasks_dirty"),
        agg_sorted("diag", " || ").alias("diagnoses"), agg_sorted("seg", " || ").alias("segments"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left"))


def _region_raw():
    return F.when(F.col("o_orderkey") % 37 == 0, F.lit(None).cast("string")) \
            .otherwise(F.concat(_s(F.col("o_custkey") % 16), F.lit(".0")))


def _specialist_raw():
    return F.when(F.col("o_custkey") % 29 == 0, F.lit(None).cast("string")) \
            .otherwise(F.concat(F.lit("ERG-"), _s(F.col("o_custkey") % 23)))


def _holding_raw():
    return F.when(F.col("o_custkey") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name"))


def plan_raw(spark: SparkSession, sf_dir: str, dirty_tasks: bool = False) -> DataFrame:
    """One raw plan row per order, headers as a delimited export has them."""
    return _memo(spark, ("plan_raw", sf_dir, dirty_tasks), lambda: _plan_raw(spark, sf_dir, dirty_tasks))


def _plan_raw(spark: SparkSession, sf_dir: str, dirty_tasks: bool) -> DataFrame:
    k7 = F.col("o_orderkey") % 7
    planned = (F.when(k7 == 0, F.lit(None).cast("string"))
                .when(k7 == 1, F.lit(""))
                .when(k7 == 2, F.lit("por definir"))
                .when(k7 == 3, F.date_format("o_orderdate", "dd-MM-yyyy"))
                .when(k7 == 4, F.date_format("o_orderdate", "dd/MM/yyyy"))
                .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    women = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("string")) \
             .otherwise(_s((F.col("o_orderkey") % 25).cast("double")))
    # every fifth order is a visit without cases
    case = lambda c: F.when(F.col("o_orderkey") % 5 != 0, F.col(c))
    # some addresses hold quotes, a comma and a line break
    address = F.when(F.col("o_custkey") % 6 == 0, F.concat(F.lit('Calle "'), _s(F.col("o_custkey")), F.lit('", piso\n2'))) \
               .otherwise(F.concat(F.lit("Calle "), _s(F.col("o_custkey"))))
    base = _base(spark, sf_dir).join(_cells(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return base.select(
        _s(F.col("o_orderkey")).alias("ID-CT"),
        planned.alias("Fecha Asistencia Tecnica TMERT 2026*"),
        _region_raw().alias("Region"),
        _specialist_raw().alias("Ergonomo"),
        F.col("c_mktsegment").alias("Gerencia - Cuenta Nacional"),
        _holding_raw().alias("Holding"),
        F.col("c_name").alias("Nombre Empleador"),
        F.concat(F.lit("CT-"), _s(F.col("o_orderkey"))).alias("Nombre CT"),
        address.alias("Direccion CT"),
        F.col("n_name").alias("Comuna CT"),
        _s((F.col("o_orderkey") % 40).cast("double")).alias("N de trabajadores(as) a evaluar 2026 N hombres"),
        women.alias("N de trabajadores(as) a evaluar 2026 N mujeres"),
        case("case_ids").alias("folios"),
        case("occupations_dirty" if dirty_tasks else "occupations").alias("ocupaciones"),
        case("tasks_dirty" if dirty_tasks else "tasks").alias("tareas"),
        case("diagnoses").alias("diagnosticos"),
        case("segments").alias("segmentos"),
    )


def followup_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw follow-up row per order, every cell text."""
    return _memo(spark, ("followup_raw", sf_dir), lambda: _followup_raw(spark, sf_dir))


def _followup_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    spellings = ["TRUE", "verdadero ", "1", "FALSE", "si", "", None]

    def pillar(i: int):
        r = ((F.col("o_orderkey") + i * F.col("o_custkey")) % 7).cast("int")
        return F.element_at(F.array(*[F.lit(s).cast("string") for s in spellings]), r + 1), r

    pillars = [pillar(i) for i in range(1, 5)]
    all_true = (pillars[0][1] < 3) & (pillars[1][1] < 3) & (pillars[2][1] < 3) & (pillars[3][1] < 3)
    goal = F.when(all_true & (F.col("o_orderkey") % 3 > 0), F.lit("TRUE")).otherwise(F.lit("FALSE"))
    k5 = F.col("o_orderkey") % 5
    status = (F.when(k5 == 0, F.lit("Pendiente atrasada")).when(k5 == 1, F.lit("Pendiente"))
               .otherwise(F.lit("Realizada")))
    k4 = F.col("o_orderkey") % 4
    diffusion = (F.when(k4 == 0, F.lit(None).cast("string"))
                  .when(k4 == 1, F.date_format("o_orderdate", "dd-MM-yyyy"))
                  .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return _base(spark, sf_dir).select(
        _region_raw().alias("Región"),
        _specialist_raw().alias("Ergonomo"),
        F.col("c_mktsegment").alias("Gerencia - Cuenta Nacional"),
        _holding_raw().alias("Holding"),
        F.col("c_name").alias("Nombre Empleador"),
        _s(F.col("o_orderkey")).alias("ID-CT"),
        F.concat(F.lit("CT-"), _s(F.col("o_orderkey"))).alias("Nombre CT"),
        F.col("n_name").alias("Comuna CT"),
        status.alias("Estado AT"),
        goal.alias("Meta 5 Cumplida"),
        pillars[0][0].alias("Pilar 1 - Difusión"),
        pillars[1][0].alias("Pilar 2 - Capacitación"),
        pillars[2][0].alias("Pilar 3 - Diseño Cap Pract"),
        pillars[3][0].alias("Pilar 4 - Prescripción Caract"),
        diffusion.alias("Fecha AT Difusión (real)"),
        F.element_at(F.array(F.lit("2026-03-31"), F.lit("30-04-2026"), F.lit("31/05/2026")), (F.col("o_orderkey") % 3 + 1).cast("int"))
         .alias("_FechaCorte"),
    )
