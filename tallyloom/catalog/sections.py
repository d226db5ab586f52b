"""The run-off analysis over source-shaped tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..plans import derived, election, reports
from ..sources import StageStore
from .registry import query

_FULL, _MINUTE, _SHOWN = "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%Y-%m-%d %H:%M:%S"


def _key(*parts: str) -> str:
    return " || '-' || ".join(["CAST(CAST(CD_MUNICIPIO AS BIGINT) AS VARCHAR)", *parts])


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _late(third_year: int) -> str:
    acre = _listed(election.ACRE_CLOCK_MUNICIPALITIES)
    return f"""CASE WHEN (emissao > TIMESTAMP '2022-10-30 17:10:00' AND SG_UF IN ({_listed(election.BRASILIA_CLOCK)}))
        OR (emissao > TIMESTAMP '2022-10-30 16:10:00' AND SG_UF IN ({_listed(election.AMAZON_CLOCK)}) AND mun NOT IN ({acre}))
        OR (emissao > TIMESTAMP '{third_year}-10-30 15:10:00' AND (SG_UF = 'AC' OR mun IN ({acre}))) THEN 1 ELSE 0 END"""


def _model(number: str) -> str:
    cases = " ".join(f"WHEN {number} BETWEEN {a} AND {b} THEN {y}" for a, b, y in election.MODEL_RANGES)
    return f"CASE {cases} ELSE {election.MODEL_OTHER} END"


def _region() -> str:
    cases = " ".join(f"WHEN SG_UF IN ({_listed(s)}) THEN '{r}'" for r, s in election.REGIONS.items())
    return f"CASE {cases} ELSE '{election.REGION_OTHER}' END"


def _ctes(repeats: bool = True, third_year: int = 2022) -> str:
    """Join the detail first and fold it afterwards; without ``repeats`` each side is made unique before."""
    once = "" if repeats else "QUALIFY ROW_NUMBER() OVER (PARTITION BY urna_id, NR_VOTAVEL ORDER BY NM_LOCAL_VOTACAO) = 1"
    one = "" if repeats else "QUALIFY ROW_NUMBER() OVER (PARTITION BY urna_id ORDER BY NR_URNA_EFETIVADA) = 1"
    return f"""WITH {derived.sources_sql()},
      b AS (SELECT *, CAST(CAST(CD_MUNICIPIO AS BIGINT) AS VARCHAR) AS mun, {_key('NR_ZONA', 'NR_SECAO')} AS urna_id,
                   {_key('NR_ZONA')} AS zona_id, {_model('NR_URNA_EFETIVADA')} AS modelo, {_region()} AS regiao,
                   TRY_STRPTIME(DT_GERACAO || ' ' || HH_GERACAO, '{_FULL}') AS geracao,
                   TRY_STRPTIME(DT_EMISSAO_BU, '{_FULL}') AS emissao, TRY_STRPTIME(DT_BU_RECEBIDO, '{_FULL}') AS recebido,
                   TRY_STRPTIME(DT_ABERTURA, '{_FULL}') AS abertura, TRY_STRPTIME(DT_ENCERRAMENTO, '{_FULL}') AS encerramento
            FROM bulletins WHERE CD_CARGO_PERGUNTA = 1),
      r AS (SELECT *, {_key('NR_ZONA', 'NR_SECAO')} AS urna_id FROM results WHERE NR_TURNO = 2 {once}),
      m AS (SELECT *, {_key('NR_ZONA', 'NR_SECAO')} AS urna_id FROM machines {one}),
      d AS (SELECT b.*, r.NM_LOCAL_VOTACAO, r.DS_LOCAL_VOTACAO_ENDERECO, m.NR_URNA_EFETIVADA AS machine, m.NR_URNA_ESPERADA,
                   m.DT_CARGA_URNA_ESPERADA, m.DT_CARGA_URNA_EFETIVADA, m.DT_RECO_URNA_ESPERADA, m.DT_RECO_URNA_EFETIVADA,
                   m.CD_CARGA_1_URNA_ESPERADA, m.CD_CARGA_1_URNA_EFETIVADA, m.CD_CARGA_2_URNA_ESPERADA, m.CD_CARGA_2_URNA_EFETIVADA,
                   m.CD_FLASHCARD_URNA_ESPERADA, m.CD_FLASHCARD_URNA_EFETIVADA, m.DS_DIVERGENCIA, m.CD_ORIGEM_VOTO,
                   {_late(third_year)} AS late,
                   ROW_NUMBER() OVER (PARTITION BY b.urna_id ORDER BY emissao NULLS FIRST, recebido, abertura, encerramento) AS b_no,
                   ROW_NUMBER() OVER (PARTITION BY b.urna_id ORDER BY m.NR_URNA_EFETIVADA NULLS FIRST) AS m_no
            FROM b JOIN r ON r.urna_id = b.urna_id AND r.NR_VOTAVEL = b.NR_VOTAVEL LEFT JOIN m ON m.urna_id = b.urna_id),
      f AS (SELECT urna_id, MAX(zona_id) AS zona_id, MAX(SG_UF) AS uf, MAX(NM_MUNICIPIO) AS cidade, MAX(NR_ZONA) AS zona,
                   MAX(NR_SECAO) AS secao, MAX(regiao) AS regiao, MAX(geracao) AS dt_geracao, MAX(emissao) AS dt_emissao_bu,
                   MAX(recebido) AS dt_bu_recebido, MAX(abertura) AS dt_abertura, MAX(encerramento) AS dt_encerramento,
                   MAX(CASE WHEN b_no = 1 THEN CAST(EPOCH(recebido) AS BIGINT) - CAST(EPOCH(emissao) AS BIGINT) END) AS segundos_emissao_bu_recebimento,
                   MAX(CASE WHEN b_no = 1 THEN CAST(EPOCH(abertura) AS BIGINT) - CAST(EPOCH(encerramento) AS BIGINT) END) AS segundos_abertura_encerramento,
                   MAX(TRY_STRPTIME(DT_CARGA_URNA_ESPERADA, '{_MINUTE}')) AS dt_carga_urna_esperada,
                   MAX(TRY_STRPTIME(DT_CARGA_URNA_EFETIVADA, '{_MINUTE}')) AS dt_carga_urna_efetivada,
                   MAX(TRY_STRPTIME(DT_RECO_URNA_ESPERADA, '{_MINUTE}')) AS dt_reco_urna_esperada,
                   MAX(TRY_STRPTIME(DT_RECO_URNA_EFETIVADA, '{_MINUTE}')) AS dt_reco_urna_efetivada,
                   MAX(mun) AS cidade_id, MAX(NR_LOCAL_VOTACAO) AS local_votacao_id, MAX(NR_JUNTA_APURADORA) AS junta_apuradora,
                   MAX(NR_TURMA_APURADORA) AS turma_apuradora, MAX(CD_FLASHCARD_URNA_ESPERADA) AS flashcard_urna_esperada,
                   MAX(CD_CARGA_1_URNA_EFETIVADA) AS carga_1_urna_efetivada, MAX(CD_CARGA_2_URNA_ESPERADA) AS carga_2_urna_esperada,
                   MAX(CD_CARGA_2_URNA_EFETIVADA) AS carga_2_urna_efetivada,
                   MAX(NULLIF(DS_AGREGADAS, '#NULO#')) AS secoes_agregadas,
                   CAST(MAX(CASE WHEN DS_AGREGADAS <> '#NULO#' THEN LEN(STRING_SPLIT(DS_AGREGADAS, ' / ')) ELSE 0 END) AS INTEGER) AS total_secoes_agregadas,
                   STRING_AGG(DISTINCT CAST(modelo AS VARCHAR), ',') AS modelos_urnas, MAX(modelo) AS modelo,
                   MAX(CASE WHEN m_no = 1 THEN machine END) AS urna_efetivada, MAX(NR_URNA_ESPERADA) AS urna_esperada,
                   MAX(CD_CARGA_1_URNA_ESPERADA) AS carga_1_urna_esperada, MAX(CD_FLASHCARD_URNA_EFETIVADA) AS flashcard_urna_efetivada,
                   MIN(NM_LOCAL_VOTACAO) AS local_votacao, MAX(DS_LOCAL_VOTACAO_ENDERECO) AS endereco,
                   MAX(CASE WHEN m_no = 1 THEN CASE CD_ORIGEM_VOTO WHEN 'U' THEN 0 WHEN 'C' THEN 1 WHEN 'R' THEN 2 WHEN 'B' THEN 3 END END) AS origem_voto,
                   MAX(CASE WHEN m_no = 1 THEN CASE WHEN DS_DIVERGENCIA = '#NULO#' THEN 0 ELSE 1 END END) AS urna_contingencia,
                   MAX(QT_APTOS) AS aptos, MAX(QT_ELEITORES_BIOMETRIA_NH) AS nao_habilitados_biometria,
                   MAX(QT_COMPARECIMENTO) AS comparecimentos, MAX(QT_ABSTENCOES) AS abstencoes, MAX(late) AS emissao_bu_pos_encerramento,
                   {', '.join(f"CAST(SUM(CASE WHEN NR_VOTAVEL = '{v}' THEN QT_VOTOS ELSE 0 END) AS BIGINT) AS {n}" for v, n in election.VOTABLES.items())}
            FROM d GROUP BY urna_id)"""


_TIMES = ("dt_geracao", "dt_emissao_bu", "dt_bu_recebido", "dt_abertura", "dt_encerramento",
          "dt_carga_urna_esperada", "dt_carga_urna_efetivada", "dt_reco_urna_esperada", "dt_reco_urna_efetivada")
_PLAIN = (
    "urna_id", "zona_id", "uf", "cidade", "zona", "secao", "regiao", "segundos_emissao_bu_recebimento",
    "segundos_abertura_encerramento", "secoes_agregadas", "total_secoes_agregadas", "modelos_urnas", "modelo",
    "urna_efetivada", "urna_esperada", "carga_1_urna_esperada", "carga_1_urna_efetivada",
    "carga_2_urna_esperada", "carga_2_urna_efetivada", "flashcard_urna_esperada", "flashcard_urna_efetivada",
    "cidade_id", "local_votacao_id", "junta_apuradora", "turma_apuradora", "local_votacao", "endereco",
    "origem_voto", "urna_contingencia", "aptos", "nao_habilitados_biometria", "comparecimentos", "abstencoes",
    "emissao_bu_pos_encerramento", "lula", "bolsonaro", "brancos", "nulos",
)
_FLAGS = """CASE WHEN modelo = 2020 THEN 1 ELSE 0 END AS modelo_2020, CASE WHEN lula > bolsonaro THEN 1 ELSE 0 END AS lulavence,
            CASE WHEN lula < bolsonaro THEN 1 ELSE 0 END AS bolsonarovence, CASE WHEN lula = bolsonaro THEN 1 ELSE 0 END AS empate"""
_RATIOS = ", ".join(f"{a} / NULLIF({b}, 0) AS {n}" for n, (a, b) in election.RATIOS.items())
_WIDE = ", ".join([*_PLAIN, *(f"STRFTIME({t}, '{_SHOWN}') AS {t}" for t in _TIMES), _FLAGS, _RATIOS])


def _shown(wide: DataFrame) -> DataFrame:
    """All columns, times as text."""
    times = wide.withColumns({t: F.date_format(t, "yyyy-MM-dd HH:mm:ss") for t in _TIMES})
    return times.select(*election.WIDE_COLUMNS)


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        election.bulletins(derived.source(spark, sf_dir, "bulletins")),
        election.results(derived.source(spark, sf_dir, "results")),
        election.machines(derived.source(spark, sf_dir, "machines")),
    )


def _sections(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return election.sections(*_prepared(spark, sf_dir), **options)


@query("election_sections", f"{_ctes()} SELECT {_WIDE} FROM f")
def election_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded before the joins, repeats multiplying the sums; the SQL joins first and folds then."""
    return _shown(_sections(spark, sf_dir, fanout="allow"))


@query("election_sections_dedupe", f"{_ctes(repeats=False)} SELECT {_WIDE} FROM f")
def election_sections_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_sections(spark, sf_dir, fanout="dedupe"))


@query(
    "election_late_faithful",
    f"{_ctes(third_year=2002)} SELECT uf, emissao_bu_pos_encerramento, COUNT(*) AS n FROM f GROUP BY 1, 2",
)
def election_late_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late sections per state with the third cut-off's year as written originally."""
    wide = _sections(spark, sf_dir, fanout="allow", faithful=True)
    return wide.groupBy("uf", "emissao_bu_pos_encerramento").agg(F.count(F.lit(1)).alias("n"))


@query(
    "election_detail",
    f"""{_ctes()} SELECT urna_id, NR_VOTAVEL, QT_VOTOS, STRFTIME(emissao, '{_SHOWN}') AS emissao, NM_LOCAL_VOTACAO AS local_votacao,
                  machine AS urna_efetivada, CASE WHEN DS_DIVERGENCIA = '#NULO#' THEN 0 ELSE 1 END AS urna_contingencia FROM d""",
)
def election_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined detail, where repeats multiply rows."""
    d = election.detail(*_prepared(spark, sf_dir))
    return d.select(
        "urna_id",
        "NR_VOTAVEL",
        "QT_VOTOS",
        F.date_format("dh_emissao_bu", "yyyy-MM-dd HH:mm:ss").alias("emissao"),
        "local_votacao",
        "urna_efetivada",
        "urna_contingencia",
    )


_ZONES = f"""z AS (SELECT {_key('NR_ZONA')} AS zona_id,
    CAST(SUM(CASE WHEN TP_CONVOCACAO = 'Não voluntárias e não voluntários' THEN QT_MESARIOS_PERFIL ELSE 0 END) AS BIGINT) AS nvoluntarios_por_zona,
    CAST(SUM(CASE WHEN TP_CONVOCACAO = 'Voluntárias e voluntários' THEN QT_MESARIOS_PERFIL ELSE 0 END) AS BIGINT) AS voluntarios_por_zona
    FROM workers WHERE TP_COMPARECIMENTO = 'Comparecimentos' AND NR_TURNO = 2 GROUP BY 1)"""


@query("election_zone_workers", f"WITH {derived.sources_sql()}, {_ZONES} SELECT * FROM z")
def election_zone_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return election.zone_workers(derived.source(spark, sf_dir, "workers"))


@query(
    "election_workers_by_attendance",
    f"""WITH {derived.sources_sql()} SELECT TP_COMPARECIMENTO, CAST(SUM(QT_MESARIOS_PERFIL) AS BIGINT) AS total
        FROM workers WHERE NR_TURNO = 2 GROUP BY 1""",
)
def election_workers_by_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return election.workers_by_attendance(derived.source(spark, sf_dir, "workers"))


@query(
    "election_section_features",
    f"""{_ctes()}, {_ZONES} SELECT urna_id, f.zona_id, lula, bolsonaro, COALESCE(nvoluntarios_por_zona, 0) AS nvoluntarios_por_zona,
        COALESCE(voluntarios_por_zona, 0) AS voluntarios_por_zona,
        CASE WHEN voluntarios_por_zona IS NOT NULL THEN 1 ELSE 0 END AS zona_tem_voluntarios
        FROM f LEFT JOIN z ON z.zona_id = f.zona_id""",
)
def election_section_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = election.zone_workers(derived.source(spark, sf_dir, "workers"))
    vm = election.with_zone_workers(_sections(spark, sf_dir, fanout="allow"), zones)
    return vm.select(
        "urna_id", "zona_id", "lula", "bolsonaro", "nvoluntarios_por_zona", "voluntarios_por_zona", "zona_tem_voluntarios"
    )




@query(
    "election_mixture",
    f"""{_ctes()} SELECT COUNT(*) AS n_sections, CAST(SUM(lula) AS BIGINT) AS sum_lula,
        CAST(SUM(bolsonaro) AS BIGINT) AS sum_bolsonaro, CAST(0 AS BIGINT) AS n_groups_out_of_range FROM f""",
)
def election_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sections to clusters to the first report: over the clusters, its sums are those of all sections."""
    store = StageStore(spark)
    zones = election.zone_workers(derived.source(spark, sf_dir, "workers"))
    vm = store.write("vm", election.with_zone_workers(_sections(spark, sf_dir, fanout="allow"), zones))
    _, labelled = election.cluster(vm, "C")
    p = store.write("p", labelled.drop("features", "probability"))
    sizes = p.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    both = reports.comparisons(p, vm)["cmp_01"]().join(sizes, "prediction")
    outside = F.when(F.col("prediction").between(0, election.MIXTURES["C"].k - 1), 0).otherwise(1)
    return both.agg(
        F.sum("n").alias("n_sections"),
        F.sum("sum_lula").alias("sum_lula"),
        F.sum("sum_bolsonaro").alias("sum_bolsonaro"),
        F.sum(outside).alias("n_groups_out_of_range"),
    )
