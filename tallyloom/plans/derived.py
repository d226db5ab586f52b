"""Source-shaped tables derived from the star-schema tables.

They hold what the delimited sources hold: padded and unpadded codes, text
times with sentinels, other offices and rounds, result rows that are missing or
repeated, sections without a machine row and with two. ``SOURCES`` is the text of
the SQL checks; Spark makes the same rows by ``_AT_SIZE``, and a test compares them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .standin import table

# A state per nation, in key order.
STATES = (
    "SP", "RJ", "MG", "ES", "SC", "PR", "RS", "GO", "PA", "AP", "DF", "TO", "BA",
    "PE", "CE", "MT", "MS", "AM", "RR", "RO", "AC", "ZZ", "RN", "PB", "AL",
)

_VOTABLE = """CASE WHEN l_returnflag = 'A' THEN '13' WHEN l_returnflag = 'R' THEN '22'
                   WHEN l_linestatus = 'F' THEN '95' ELSE '96' END"""


def _one_of(texts: Sequence[str], number: str) -> str:
    """SQL that picks one of some texts by a number, from 0 and around."""
    cases = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts))
    return f"CASE {number} % {len(texts)} {cases} END"


def _section_code(offset: int) -> str:
    """SQL of a padded code that is constant per section and differs by ``offset``."""
    return f"LPAD(CAST(o_orderkey % 97 + {100 * offset} AS STRING), 6, '0')"


def _municipality(state_key: str) -> str:
    return f"""CASE WHEN {state_key} = 17 AND c_mktsegment = 'BUILDING' THEN '02054'
                    WHEN {state_key} = 0 AND c_mktsegment = 'MACHINERY' THEN '02917'
                    ELSE LPAD(CAST(1000 + {state_key} * 10 AS STRING), 5, '0') END"""


_ZONE = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'FURNITURE' THEN '3'
                             WHEN 'HOUSEHOLD' THEN '4' ELSE '5' END"""

_PLACES = f"""SELECT o.*, n_nationkey, n_name, c_mktsegment, {_municipality('n_nationkey')} AS municipality, {_ZONE} AS zone_no
              FROM {{orders}} AS o JOIN {{customer}} AS c ON o.o_custkey = c.c_custkey
                   JOIN {{nation}} AS n ON c.c_nationkey = n.n_nationkey"""

# Known origin codes, and one that is not.
ORIGIN_CODES = ("U", "C", "R", "B", "X")

# Minutes and seconds on both sides of the cut-offs.
_MINUTE = _one_of(("08", "09", "10", "11", "30"), "(l_orderkey + l_linenumber)")
_SECOND = _one_of(("00", "01", "59"), "l_partkey")

SOURCES = {
    "bulletins": f"""
      SELECT CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END AS CD_CARGO_PERGUNTA,
             {_one_of(STATES, 'n_nationkey')} AS SG_UF,
             municipality AS CD_MUNICIPIO, n_name AS NM_MUNICIPIO, zone_no AS NR_ZONA,
             CAST(o_orderkey AS STRING) AS NR_SECAO, '10' || zone_no AS NR_LOCAL_VOTACAO,
             CASE WHEN o_orderkey % 3 = 0 THEN '#NULO#' ELSE {_section_code(9)} END AS NR_JUNTA_APURADORA, c_mktsegment AS NR_TURMA_APURADORA,
             999000 + (o_custkey % 1500) * 830 AS NR_URNA_EFETIVADA,
             '30/10/2022' AS DT_GERACAO, CASE WHEN o_orderstatus = 'F' THEN '#NULO#' ELSE '10:11:12' END AS HH_GERACAO,
             CASE WHEN l_partkey % 50 = 0 THEN '#NULO#'
                  ELSE '30/10/2022 1' || CAST(5 + l_suppkey % 3 AS STRING) || ':' || {_MINUTE} || ':' || {_SECOND} END AS DT_EMISSAO_BU,
             '30/10/2022 18:' || {_MINUTE} || ':' || {_SECOND} AS DT_BU_RECEBIDO,
             '30/10/2022 0' || CAST(6 + l_orderkey % 3 AS STRING) || ':00:0' || CAST(l_orderkey % 7 AS STRING) AS DT_ABERTURA,
             '30/10/2022 17:00:0' || CAST(l_linenumber AS STRING) AS DT_ENCERRAMENTO,
             CASE o_orderpriority WHEN '1-URGENT' THEN '10 / 20 / 30' WHEN '2-HIGH' THEN '7' ELSE '#NULO#' END AS DS_AGREGADAS,
             {_VOTABLE} AS NR_VOTAVEL,
             CAST(l_quantity AS BIGINT) AS QT_VOTOS, CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS QT_APTOS,
             CAST(FLOOR(o_totalprice / 1250) AS BIGINT) AS QT_COMPARECIMENTO,
             CAST(FLOOR(o_totalprice / 1000) AS BIGINT) - CAST(FLOOR(o_totalprice / 1250) AS BIGINT) AS QT_ABSTENCOES,
             o_custkey % 9 AS QT_ELEITORES_BIOMETRIA_NH
      FROM {{lineitem}} AS l JOIN ({_PLACES}) AS p ON l.l_orderkey = p.o_orderkey""",
    "results": f"""
      SELECT round_no AS NR_TURNO, CAST(CAST(municipality AS BIGINT) AS STRING) AS CD_MUNICIPIO, zone_no AS NR_ZONA,
             CAST(o_orderkey AS STRING) AS NR_SECAO, votable AS NR_VOTAVEL, place AS NM_LOCAL_VOTACAO,
             'STREET ' || zone_no AS DS_LOCAL_VOTACAO_ENDERECO
      FROM (SELECT l_orderkey, votable, CASE WHEN low % 20 = 0 THEN 1 ELSE 2 END AS round_no, 'SCHOOL' AS place
            FROM (SELECT l_orderkey, {_VOTABLE} AS votable, MIN(l_partkey) AS low, MAX(l_suppkey) AS high
                  FROM {{lineitem}} AS l GROUP BY l_orderkey, {_VOTABLE}) AS once
            UNION ALL
            SELECT l_orderkey, votable, 2 AS round_no, 'ANNEX' AS place
            FROM (SELECT l_orderkey, {_VOTABLE} AS votable, MIN(l_partkey) AS low, MAX(l_suppkey) AS high
                  FROM {{lineitem}} AS l GROUP BY l_orderkey, {_VOTABLE}) AS again WHERE high % 25 = 0) AS v
           JOIN ({_PLACES}) AS p ON v.l_orderkey = p.o_orderkey""",
    "machines": f"""
      SELECT municipality AS CD_MUNICIPIO, zone_no AS NR_ZONA, CAST(o_orderkey AS STRING) AS NR_SECAO,
             '20/10/2022 09:15' AS DT_CARGA_URNA_ESPERADA,
             CASE WHEN o_orderstatus = 'F' THEN '20/10/2022 10:45' ELSE '#NULO#' END AS DT_CARGA_URNA_EFETIVADA,
             CASE WHEN o_orderkey % 2 = 0 THEN '31/02/2022 09:15' ELSE '19/10/2022 08:05' END AS DT_RECO_URNA_ESPERADA,
             '2' || CAST(o_orderkey % 7 AS STRING) || '/10/2022 00:00' AS DT_RECO_URNA_EFETIVADA,
             machine AS NR_URNA_EFETIVADA, {_section_code(0)} AS NR_URNA_ESPERADA,
             {_section_code(1)} AS CD_CARGA_URNA_ESPERADA, {_section_code(2)} AS CD_CARGA_1_URNA_ESPERADA,
             {_section_code(3)} AS CD_CARGA_2_URNA_ESPERADA, {_section_code(4)} AS CD_CARGA_URNA_EFETIVADA,
             {_section_code(5)} AS CD_CARGA_1_URNA_EFETIVADA, {_section_code(6)} AS CD_CARGA_2_URNA_EFETIVADA,
             {_section_code(7)} AS CD_FLASHCARD_URNA_ESPERADA, {_section_code(8)} AS CD_FLASHCARD_URNA_EFETIVADA,
             'ORIGIN' AS DS_ORIGEM_VOTO, deviation AS DS_DIVERGENCIA,
             {_one_of(ORIGIN_CODES, '(zone_key - 1)')} AS CD_ORIGEM_VOTO
      FROM (SELECT p.*, CAST(zone_no AS INT) AS zone_key, '0' || CAST(o_custkey AS STRING) AS machine,
                   CASE WHEN o_orderpriority = '5-LOW' THEN '#DIV' ELSE '#NULO#' END AS deviation
            FROM ({_PLACES}) AS p WHERE o_orderstatus <> 'O'
            UNION ALL
            SELECT p.*, CAST(zone_no AS INT) AS zone_key, 'Z' AS machine, '#DIV' AS deviation
            FROM ({_PLACES}) AS p WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS m""",
    "workers": """
      SELECT CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 2 END AS NR_TURNO,
             LPAD(CAST(1000 + s_nationkey * 10 AS STRING), 5, '0') AS CD_MUNICIPIO,
             CAST(1 + s_suppkey % 5 AS STRING) AS NR_ZONA,
             CASE WHEN s_suppkey % 7 = 0 THEN 'Faltas' ELSE 'Comparecimentos' END AS TP_COMPARECIMENTO,
             CASE WHEN s_suppkey % 3 = 0 THEN 'Voluntárias e voluntários' ELSE 'Não voluntárias e não voluntários' END AS TP_CONVOCACAO,
             CAST(FLOOR(ABS(s_acctbal) / 100) AS BIGINT) AS QT_MESARIOS_PERFIL
      FROM {supplier} AS s""",
}

_INPUTS = ("lineitem", "orders", "customer", "nation", "supplier")


# The same rows for Spark at size: what a section's lines share is worked out before lines join, and no table is read twice.
_SECTIONS = f"""SELECT o_orderkey, {_one_of(STATES, 'n_nationkey')} AS SG_UF, municipality AS CD_MUNICIPIO, n_name AS NM_MUNICIPIO, zone_no AS NR_ZONA,
             '10' || zone_no AS NR_LOCAL_VOTACAO,
             CASE WHEN o_orderkey % 3 = 0 THEN '#NULO#' ELSE {_section_code(9)} END AS NR_JUNTA_APURADORA, c_mktsegment AS NR_TURMA_APURADORA,
             999000 + (o_custkey % 1500) * 830 AS NR_URNA_EFETIVADA,
             CASE WHEN o_orderstatus = 'F' THEN '#NULO#' ELSE '10:11:12' END AS HH_GERACAO,
             CASE o_orderpriority WHEN '1-URGENT' THEN '10 / 20 / 30' WHEN '2-HIGH' THEN '7' ELSE '#NULO#' END AS DS_AGREGADAS,
             CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS QT_APTOS, CAST(FLOOR(o_totalprice / 1250) AS BIGINT) AS QT_COMPARECIMENTO,
             o_custkey % 9 AS QT_ELEITORES_BIOMETRIA_NH
      FROM ({_PLACES}) AS places"""

_SCHOOL = "STRUCT(CASE WHEN low % 20 = 0 THEN 1 ELSE 2 END AS round_no, 'SCHOOL' AS place)"
_ANNEX = "STRUCT(2 AS round_no, 'ANNEX' AS place)"
_OWN = """STRUCT('0' || CAST(o_custkey AS STRING) AS machine,
                 CASE WHEN o_orderpriority = '5-LOW' THEN '#DIV' ELSE '#NULO#' END AS deviation)"""
_SPARE = "STRUCT('Z' AS machine, '#DIV' AS deviation)"

_AT_SIZE = {
    "bulletins": f"""
      SELECT CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END AS CD_CARGO_PERGUNTA,
             SG_UF, CD_MUNICIPIO, NM_MUNICIPIO, NR_ZONA, CAST(o_orderkey AS STRING) AS NR_SECAO, NR_LOCAL_VOTACAO,
             NR_JUNTA_APURADORA, NR_TURMA_APURADORA, NR_URNA_EFETIVADA, '30/10/2022' AS DT_GERACAO, HH_GERACAO,
             CASE WHEN l_partkey % 50 = 0 THEN '#NULO#'
                  ELSE '30/10/2022 1' || CAST(5 + l_suppkey % 3 AS STRING) || ':' || minute || ':' || second END AS DT_EMISSAO_BU,
             '30/10/2022 18:' || minute || ':' || second AS DT_BU_RECEBIDO,
             '30/10/2022 0' || CAST(6 + l_orderkey % 3 AS STRING) || ':00:0' || CAST(l_orderkey % 7 AS STRING) AS DT_ABERTURA,
             '30/10/2022 17:00:0' || CAST(l_linenumber AS STRING) AS DT_ENCERRAMENTO,
             DS_AGREGADAS, votable AS NR_VOTAVEL, CAST(l_quantity AS BIGINT) AS QT_VOTOS, QT_APTOS, QT_COMPARECIMENTO,
             QT_APTOS - QT_COMPARECIMENTO AS QT_ABSTENCOES, QT_ELEITORES_BIOMETRIA_NH
      FROM (SELECT l.*, {_VOTABLE} AS votable, {_MINUTE} AS minute, {_SECOND} AS second FROM {{lineitem}} AS l) AS l
           JOIN ({_SECTIONS}) AS p ON l.l_orderkey = p.o_orderkey""",
    "results": f"""
      SELECT round_no AS NR_TURNO, CAST(CAST(municipality AS BIGINT) AS STRING) AS CD_MUNICIPIO, zone_no AS NR_ZONA,
             CAST(o_orderkey AS STRING) AS NR_SECAO, votable AS NR_VOTAVEL, place AS NM_LOCAL_VOTACAO,
             'STREET ' || zone_no AS DS_LOCAL_VOTACAO_ENDERECO
      FROM (SELECT l_orderkey, votable, INLINE(IF(high % 25 = 0, ARRAY({_SCHOOL}, {_ANNEX}), ARRAY({_SCHOOL})))
            FROM (SELECT l_orderkey, {_VOTABLE} AS votable, MIN(l_partkey) AS low, MAX(l_suppkey) AS high
                  FROM {{lineitem}} AS l GROUP BY l_orderkey, {_VOTABLE}) AS folded) AS v
           JOIN ({_PLACES}) AS p ON v.l_orderkey = p.o_orderkey""",
    # The list of columns is that of SOURCES, over one reading of the sections.
    "machines": SOURCES["machines"].split("FROM (SELECT p.*")[0]
    + f"""FROM (SELECT p.*, CAST(zone_no AS INT) AS zone_key,
                   INLINE(IF(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT', ARRAY({_OWN}, {_SPARE}), ARRAY({_OWN})))
            FROM ({_PLACES}) AS p WHERE o_orderstatus <> 'O') AS m""",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the four source tables."""
    text = _AT_SIZE.get(name, SOURCES[name])
    return spark.sql(text, **{i: table(spark, sf_dir, i) for i in _INPUTS if "{" + i + "}" in text})


def sources_sql() -> str:
    """The same as common table expressions."""
    names = {name: name for name in _INPUTS}
    return ", ".join(f"{name} AS ({text.format(**names)})" for name, text in SOURCES.items())
