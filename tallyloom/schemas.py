"""Declared schemas of the source tables. Codes are text, so leading zeros survive."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**types: str) -> T.StructType:
    names = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType()}
    return T.StructType([T.StructField(c, names[t], True) for c, t in types.items()])


# Column names of the published files.

# One row per section and votable number.
BULLETINS = _schema(
    CD_CARGO_PERGUNTA="int",
    SG_UF="string",
    CD_MUNICIPIO="string",
    NM_MUNICIPIO="string",
    NR_ZONA="string",
    NR_SECAO="string",
    NR_LOCAL_VOTACAO="string",
    NR_JUNTA_APURADORA="string",
    NR_TURMA_APURADORA="string",
    NR_URNA_EFETIVADA="bigint",
    DT_GERACAO="string",
    HH_GERACAO="string",
    DT_EMISSAO_BU="string",
    DT_BU_RECEBIDO="string",
    DT_ABERTURA="string",
    DT_ENCERRAMENTO="string",
    DS_AGREGADAS="string",
    NR_VOTAVEL="string",
    QT_VOTOS="bigint",
    QT_APTOS="bigint",
    QT_COMPARECIMENTO="bigint",
    QT_ABSTENCOES="bigint",
    QT_ELEITORES_BIOMETRIA_NH="bigint",
)

# One row per section and votable number (and office).
RESULTS = _schema(
    NR_TURNO="int",
    CD_MUNICIPIO="string",
    NR_ZONA="string",
    NR_SECAO="string",
    NR_VOTAVEL="string",
    NM_LOCAL_VOTACAO="string",
    DS_LOCAL_VOTACAO_ENDERECO="string",
)

# One row per section; repeats are possible.
MACHINES = _schema(
    CD_MUNICIPIO="string",
    NR_ZONA="string",
    NR_SECAO="string",
    DT_CARGA_URNA_ESPERADA="string",
    DT_CARGA_URNA_EFETIVADA="string",
    DT_RECO_URNA_ESPERADA="string",
    DT_RECO_URNA_EFETIVADA="string",
    NR_URNA_EFETIVADA="string",
    NR_URNA_ESPERADA="string",
    CD_CARGA_URNA_ESPERADA="string",
    CD_CARGA_1_URNA_ESPERADA="string",
    CD_CARGA_2_URNA_ESPERADA="string",
    CD_CARGA_URNA_EFETIVADA="string",
    CD_CARGA_1_URNA_EFETIVADA="string",
    CD_CARGA_2_URNA_EFETIVADA="string",
    CD_FLASHCARD_URNA_ESPERADA="string",
    CD_FLASHCARD_URNA_EFETIVADA="string",
    DS_ORIGEM_VOTO="string",
    DS_DIVERGENCIA="string",
    CD_ORIGEM_VOTO="string",
)

# One row per zone and poll-worker profile.
WORKERS = _schema(
    NR_TURNO="int",
    CD_MUNICIPIO="string",
    NR_ZONA="string",
    TP_COMPARECIMENTO="string",
    TP_CONVOCACAO="string",
    QT_MESARIOS_PERFIL="bigint",
)
