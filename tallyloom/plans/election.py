"""The run-off analysis: source tables to one wide row per section, with zone features.

Sections are folded *before* they are joined. Each side is reduced to one row
per join key, starting in its own map tasks, so the joins see unique keys: they
cannot multiply rows, and no key is heavier than another. Where a side did hold
repeats, their number is carried along and applied to the sums, which gives the
figures that folding the multiplied detail would give.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import (
    LateRule,
    code_decode,
    composite_key,
    elapsed_seconds,
    equals_flag,
    floor_positive_columns,
    late_expr,
    list_item_count,
    member_bucket,
    parse_date_time,
    parse_timestamp,
    range_bucket,
    sentinel_flag,
    sentinel_to_null,
)
from ..functions.derive import DATE_MINUTE
from ..operators import (
    MixtureFit,
    conditional_sum_by_key,
    enrich_detail,
    fit_mixture,
    label_mask,
    left_join_default,
    mask_labels,
    row_pick,
    save_mixture,
    tally_columns,
    tally_ratios,
    winner_flags,
)
from ..sources import StageStore, read_delimited, write_delimited, write_partitioned, write_sorted

# Machine number ranges and the model year of each.
MODEL_RANGES = (
    (999500, 1220500, 2009),
    (1220501, 1345500, 2010),
    (1368501, 1370500, 2011),
    (1600000, 1650000, 2011),
    (1650001, 1701000, 2013),
    (1750000, 1950000, 2015),
    (2000000, 2250000, 2020),
)
MODEL_OTHER = 1
MODELS = tuple(sorted({MODEL_OTHER, *(label for _, _, label in MODEL_RANGES)}))

# Regions and their states. Any other state is in the north-east.
REGIONS = {
    "SE": ("SP", "RJ", "ES", "MG"),
    "S": ("RS", "SC", "PR"),
    "CO": ("MT", "MS", "DF", "GO"),
    "N": ("AM", "PA", "AP", "RO", "RR", "TO", "AC"),
    "ZZ": ("ZZ",),
}
REGION_OTHER = "NE"

# Votable numbers and the tally column of each.
VOTABLES = {"13": "lula", "22": "bolsonaro", "95": "brancos", "96": "nulos"}

# Origin codes.
ORIGINS = {"U": 0, "C": 1, "R": 2, "B": 3}

# States and municipalities by clock.
BRASILIA_CLOCK = (
    "SP", "RJ", "MG", "ES", "SC", "PR", "RS", "GO", "PA", "AP", "DF",
    "TO", "BA", "PE", "CE", "MA", "PI", "SE", "RN", "PB", "AL",
)
AMAZON_CLOCK = ("MT", "MS", "AM", "RR", "RO")
ACRE_CLOCK = ("AC",)
ACRE_CLOCK_MUNICIPALITIES = (
    "2917", "2054", "2135", "2151", "2291", "2313", "2020", "2399", "98370", "2712", "2766",
)

# What the worker files call attendance and the two kinds of summons.
ATTENDED = "Comparecimentos"
SUMMONS = {
    "nvoluntarios_por_zona": "Não voluntárias e não voluntários",
    "voluntarios_por_zona": "Voluntárias e voluntários",
}

# Section attributes, constant per section: {wide column: bulletin column}. They are
# picked as they were read, and what follows from them is derived once per section.
SECTION_ATTRIBUTES = {
    "uf": "SG_UF",
    "cidade": "NM_MUNICIPIO",
    "zona": "NR_ZONA",
    "secao": "NR_SECAO",
    "local_votacao_id": "NR_LOCAL_VOTACAO",
    "cidade_id": "CD_MUNICIPIO",
    "junta_apuradora": "NR_JUNTA_APURADORA",
    "turma_apuradora": "NR_TURMA_APURADORA",
    "aptos": "QT_APTOS",
    "nao_habilitados_biometria": "QT_ELEITORES_BIOMETRIA_NH",
    "comparecimentos": "QT_COMPARECIMENTO",
    "abstencoes": "QT_ABSTENCOES",
    "_agregadas": "DS_AGREGADAS",
    "_urna": "NR_URNA_EFETIVADA",
    "_dia": "DT_GERACAO",
    "_hora": "HH_GERACAO",
    "_emissao": "DT_EMISSAO_BU",
    "_recebido": "DT_BU_RECEBIDO",
    "_abertura": "DT_ABERTURA",
    "_encerramento": "DT_ENCERRAMENTO",
}
PLACE_ATTRIBUTES = {"local_votacao": "NM_LOCAL_VOTACAO", "endereco": "DS_LOCAL_VOTACAO_ENDERECO"}
MACHINE_ATTRIBUTES = {
    "_carga_esperada": "DT_CARGA_URNA_ESPERADA",
    "_carga_efetivada": "DT_CARGA_URNA_EFETIVADA",
    "_reco_esperada": "DT_RECO_URNA_ESPERADA",
    "_reco_efetivada": "DT_RECO_URNA_EFETIVADA",
    "urna_efetivada": "NR_URNA_EFETIVADA",
    "urna_esperada": "NR_URNA_ESPERADA",
    "carga_urna_esperada": "CD_CARGA_URNA_ESPERADA",
    "carga_1_urna_esperada": "CD_CARGA_1_URNA_ESPERADA",
    "carga_2_urna_esperada": "CD_CARGA_2_URNA_ESPERADA",
    "carga_urna_efetivada": "CD_CARGA_URNA_EFETIVADA",
    "carga_1_urna_efetivada": "CD_CARGA_1_URNA_EFETIVADA",
    "carga_2_urna_efetivada": "CD_CARGA_2_URNA_EFETIVADA",
    "flashcard_urna_esperada": "CD_FLASHCARD_URNA_ESPERADA",
    "flashcard_urna_efetivada": "CD_FLASHCARD_URNA_EFETIVADA",
    "ds_origem_voto": "DS_ORIGEM_VOTO",
    "_divergencia": "DS_DIVERGENCIA",
    "_origem": "CD_ORIGEM_VOTO",
}
MACHINE_TIMES = ("carga_urna_esperada", "carga_urna_efetivada", "reco_urna_esperada", "reco_urna_efetivada")
LATEST = {
    "dt_emissao_bu": "dh_emissao_bu",
    "dt_bu_recebido": "dh_bu_recebido",
    "dt_abertura": "dh_abertura",
    "dt_encerramento": "dh_encerramento",
}
RATIOS = {
    **{f"{name}_por_aptos": (name, "aptos") for name in VOTABLES.values()},
    "abstencoes_por_aptos": ("abstencoes", "aptos"),
    "tx_comparecimento": ("comparecimentos", "aptos"),
    "tx_nao_habilitados_biometria": ("nao_habilitados_biometria", "aptos"),
}

# Columns of the wide section table, in order.
WIDE_COLUMNS = (
    "dt_geracao", "uf", "cidade", "zona", "secao", "local_votacao_id", "cidade_id", "urna_id", "zona_id",
    "regiao", "dt_emissao_bu", "dt_bu_recebido", "dt_abertura", "dt_encerramento",
    "segundos_emissao_bu_recebimento", "segundos_abertura_encerramento", "dt_carga_urna_esperada",
    "dt_carga_urna_efetivada", "junta_apuradora", "turma_apuradora", "secoes_agregadas",
    "total_secoes_agregadas", "modelos_urnas", "modelo", "modelo_2020", "urna_efetivada", "urna_esperada",
    "flashcard_urna_esperada", "flashcard_urna_efetivada", "carga_1_urna_esperada", "carga_1_urna_efetivada",
    "carga_2_urna_esperada", "carga_2_urna_efetivada", "dt_reco_urna_esperada", "dt_reco_urna_efetivada",
    "local_votacao", "endereco", "origem_voto", "urna_contingencia", "aptos", "nao_habilitados_biometria",
    "lula", "bolsonaro", "brancos", "nulos", "lulavence", "bolsonarovence", "empate", "lula_por_aptos",
    "bolsonaro_por_aptos", "brancos_por_aptos", "nulos_por_aptos", "emissao_bu_pos_encerramento",
    "abstencoes_por_aptos", "tx_comparecimento", "tx_nao_habilitados_biometria", "comparecimentos",
    "abstencoes",
)

# Mixture features: the six floored ratios, or the ten raw columns of the earlier variants.
FLOORED = {
    "bolsonaro_por_aptos": "bopa",
    "lula_por_aptos": "lupa",
    "brancos_por_aptos": "bpa",
    "nulos_por_aptos": "npa",
    "abstencoes_por_aptos": "apa",
    "tx_nao_habilitados_biometria": "txnhbpa",
}
RAW_FEATURES = (
    "bolsonaro_por_aptos", "lula_por_aptos", "brancos_por_aptos", "nulos_por_aptos", "abstencoes_por_aptos",
    "modelo_2020", "urna_contingencia", "emissao_bu_pos_encerramento", "tx_nao_habilitados_biometria",
    "voluntarios_por_zona",
)


@dataclass(frozen=True)
class MixtureSettings:
    features: tuple[str, ...]
    floored: bool
    scaled: bool
    seed: int
    max_iter: int
    tol: float
    k: int = 4


# The settings of the three variants (Spark's defaults are 100 and 0.01).
MIXTURES = {
    "C": MixtureSettings(tuple(FLOORED.values()), True, False, 42, 10000, 0.01),
    "N": MixtureSettings(RAW_FEATURES, False, True, 12345, 100000, 0.01),
    "V": MixtureSettings(RAW_FEATURES, False, False, 12345, 100, 0.01),
}


def late_rules(faithful: bool = False) -> list[LateRule]:
    """Ten minutes after closing on each of the three clocks.

    ``faithful`` keeps the year 2002 that the original text has in its third
    cut-off, which makes every timed row under it late.
    """
    third_year = "2002" if faithful else "2022"
    listed = {"CD_MUNICIPIO": ACRE_CLOCK_MUNICIPALITIES}
    return [
        LateRule("2022-10-30 17:10:00", {"SG_UF": BRASILIA_CLOCK}),
        LateRule("2022-10-30 16:10:00", {"SG_UF": AMAZON_CLOCK}, listed),
        LateRule(f"{third_year}-10-30 15:10:00", {"SG_UF": ACRE_CLOCK, **listed}),
    ]


def code(name: str) -> Column:
    """A key code as the text of its number, so that files that pad codes meet those that do not."""
    return F.coalesce(F.col(name).try_cast("bigint").cast("string"), F.col(name)).alias(name)


def read_sources(
    spark: SparkSession, bulletins: str, results: str, machines: str, workers: str
) -> dict[str, DataFrame]:
    """The four source tables from globs of delimited text."""
    return {
        "bulletins": read_delimited(spark, bulletins, schemas.BULLETINS),
        "results": read_delimited(spark, results, schemas.RESULTS),
        "machines": read_delimited(spark, machines, schemas.MACHINES),
        "workers": read_delimited(spark, workers, schemas.WORKERS),
    }


def _keyed(df: DataFrame, *codes: str) -> DataFrame:
    df = df.withColumns({c: code(c) for c in codes})
    if "NR_SECAO" in codes:
        return df.withColumn("urna_id", composite_key("CD_MUNICIPIO", "NR_ZONA", "NR_SECAO"))
    return df.withColumn("zona_id", composite_key("CD_MUNICIPIO", "NR_ZONA"))


def bulletins(source: DataFrame, office: int = 1) -> DataFrame:
    """Bulletin rows of one office with keys, model, region and parsed times."""
    rows = _keyed(
        source.where(F.col("CD_CARGO_PERGUNTA") == office), "CD_MUNICIPIO", "NR_ZONA", "NR_SECAO", "NR_VOTAVEL"
    )
    return rows.withColumns(
        {
            "zona_id": composite_key("CD_MUNICIPIO", "NR_ZONA"),
            "modelo": range_bucket("NR_URNA_EFETIVADA", MODEL_RANGES, MODEL_OTHER),
            "regiao": member_bucket("SG_UF", REGIONS, REGION_OTHER),
            "dh_geracao": parse_date_time("DT_GERACAO", "HH_GERACAO"),
            "dh_emissao_bu": parse_timestamp("DT_EMISSAO_BU"),
            "dh_bu_recebido": parse_timestamp("DT_BU_RECEBIDO"),
            "dh_abertura": parse_timestamp("DT_ABERTURA"),
            "dh_encerramento": parse_timestamp("DT_ENCERRAMENTO"),
        }
    ).drop("CD_CARGO_PERGUNTA")


def results(source: DataFrame, round_no: int = 2) -> DataFrame:
    return _keyed(source.where(F.col("NR_TURNO") == round_no), "CD_MUNICIPIO", "NR_ZONA", "NR_SECAO", "NR_VOTAVEL")


def machines(source: DataFrame) -> DataFrame:
    rows = _keyed(source, "CD_MUNICIPIO", "NR_ZONA", "NR_SECAO")
    return rows.withColumns({f"dh_{t}": parse_timestamp(f"DT_{t.upper()}", DATE_MINUTE) for t in MACHINE_TIMES})


def detail(b: DataFrame, r: DataFrame, m: DataFrame, unmatched: str = "one") -> DataFrame:
    """Bulletin rows with place and machine columns, at the grain of the bulletins (repeats multiply)."""
    renamed = {n: c for n, c in MACHINE_ATTRIBUTES.items() if not n.startswith("_")}
    times = {f"dh_{n}": f"dh_{n}" for n in MACHINE_TIMES}
    raw = {f"_m{n}": c for n, c in MACHINE_ATTRIBUTES.items() if n.startswith("_")}
    return enrich_detail(
        b,
        r,
        ["urna_id", "NR_VOTAVEL"],
        m,
        ["urna_id"],
        PLACE_ATTRIBUTES,
        {
            **renamed,
            **times,
            **raw,
            "urna_contingencia": sentinel_flag("extra.DS_DIVERGENCIA", unmatched=unmatched),
            "origem_voto": code_decode("extra.CD_ORIGEM_VOTO", ORIGINS),
        },
    )


def _copies(fanout: str, side: str) -> Column:
    """Aggregate: how often a key's rows count; evaluated with the fold, so no audit pass is needed."""
    n = F.count(F.lit(1))
    if fanout == "dedupe":
        return F.lit(1).cast("bigint")
    if fanout == "allow":
        return n
    message = F.lit(f"{side}: several rows for one key; choose fanout 'dedupe' or 'allow'")
    return F.when(n == 1, n).otherwise(F.raise_error(message).cast("bigint"))


def sections(
    b: DataFrame,
    r: DataFrame,
    m: DataFrame,
    fanout: str = "error",
    faithful: bool = False,
    unmatched: str = "one",
    votables: Mapping[str, str] = VOTABLES,
) -> DataFrame:
    """One wide row per section that has a result row for at least one of its votables.

    ``fanout`` is what repeated result or machine rows do: ``error`` fails the
    job that reads the sums, ``dedupe`` counts each bulletin row once, ``allow``
    multiplies the sums.
    """
    if fanout not in ("error", "dedupe", "allow"):
        raise ValueError("fanout must be 'error', 'dedupe' or 'allow'")
    votable = ["urna_id", "NR_VOTAVEL"]
    # Model and times are worked out by the fold from what it picks, so that the rows it sorts are no wider than that, and in
    # methods small enough for the JVM to compile; as columns before the sort they make one that it interprets.
    per_votable = b.groupBy(*votable).agg(
        row_pick(SECTION_ATTRIBUTES, "_section"),
        F.sum("QT_VOTOS").alias("_votes"),
        F.bit_or(label_mask(range_bucket("NR_URNA_EFETIVADA", MODEL_RANGES, MODEL_OTHER), MODELS)).alias("_models"),
        F.max(late_expr(parse_timestamp("DT_EMISSAO_BU"), late_rules(faithful))).alias("_late"),
        *[F.max(parse_timestamp(n.upper())).alias(n) for n in LATEST],
    )
    places = r.groupBy(*votable).agg(row_pick(PLACE_ATTRIBUTES, "_place"), _copies(fanout, "results").alias("_n_results"))
    units = m.groupBy("urna_id").agg(row_pick(MACHINE_ATTRIBUTES, "_machine"), _copies(fanout, "machines").alias("_n_machines"))

    folded = (
        per_votable.join(places, votable, "inner")
        .groupBy("urna_id")
        .agg(
            F.min("_section").alias("_section"),
            F.min("_place").alias("_place"),
            F.bit_or("_models").alias("_models"),
            F.max("_late").alias("emissao_bu_pos_encerramento"),
            *[F.max(n).alias(n) for n in LATEST],
            *tally_columns("NR_VOTAVEL", F.col("_votes") * F.col("_n_results"), votables),
        )
    )
    copies = F.coalesce(F.col("_n_machines"), F.lit(1))
    wide = folded.join(units, "urna_id", "left").withColumns({n: F.col(n) * copies for n in votables.values()})
    return _finish(wide.select("*", "_section.*", "_place.*", "_machine.*"), unmatched)


def _finish(wide: DataFrame, unmatched: str) -> DataFrame:
    """What follows from the picked attributes, once per section."""
    times = {n: parse_timestamp(n) for n in ("_emissao", "_recebido", "_abertura", "_encerramento")}
    derived = {
        "zona_id": composite_key("cidade_id", "zona"),
        "regiao": member_bucket("uf", REGIONS, REGION_OTHER),
        "dt_geracao": parse_date_time("_dia", "_hora"),
        "segundos_emissao_bu_recebimento": elapsed_seconds(times["_recebido"], times["_emissao"]),
        "segundos_abertura_encerramento": elapsed_seconds(times["_abertura"], times["_encerramento"]),
        "dt_carga_urna_esperada": parse_timestamp("_carga_esperada", DATE_MINUTE),
        "dt_carga_urna_efetivada": parse_timestamp("_carga_efetivada", DATE_MINUTE),
        "dt_reco_urna_esperada": parse_timestamp("_reco_esperada", DATE_MINUTE),
        "dt_reco_urna_efetivada": parse_timestamp("_reco_efetivada", DATE_MINUTE),
        "secoes_agregadas": sentinel_to_null("_agregadas"),
        "total_secoes_agregadas": list_item_count("_agregadas"),
        "modelos_urnas": mask_labels("_models", MODELS),
        "modelo": range_bucket("_urna", MODEL_RANGES, MODEL_OTHER),
        "modelo_2020": equals_flag(range_bucket("_urna", MODEL_RANGES, MODEL_OTHER), 2020),
        "urna_contingencia": sentinel_flag("_divergencia", unmatched=unmatched),
        "origem_voto": code_decode("_origem", ORIGINS),
    }
    wide = winner_flags(wide.withColumns(derived), "lula", "bolsonaro", "lulavence", "bolsonarovence", "empate")
    return tally_ratios(wide, RATIOS).select(*WIDE_COLUMNS)


def workers_by_attendance(source: DataFrame, round_no: int = 2) -> DataFrame:
    rows = source.where(F.col("NR_TURNO") == round_no)
    return rows.groupBy("TP_COMPARECIMENTO").agg(F.sum("QT_MESARIOS_PERFIL").alias("total"))


def zone_workers(source: DataFrame, round_no: int = 2) -> DataFrame:
    """Attending poll workers per zone, volunteers and others."""
    rows = source.withColumns({c: code(c) for c in ("CD_MUNICIPIO", "NR_ZONA")})
    return conditional_sum_by_key(
        rows,
        {"zona_id": composite_key("CD_MUNICIPIO", "NR_ZONA")},
        "QT_MESARIOS_PERFIL",
        {name: F.col("TP_CONVOCACAO") == kind for name, kind in SUMMONS.items()},
        where=(F.col("TP_COMPARECIMENTO") == ATTENDED) & (F.col("NR_TURNO") == round_no),
    )


def with_zone_workers(v: DataFrame, zones: DataFrame) -> DataFrame:
    return left_join_default(
        v, zones, ["zona_id"], dict.fromkeys(SUMMONS, 0), {"zona_tem_voluntarios": "voluntarios_por_zona"}
    )


def mixture_input(vm: DataFrame, settings: MixtureSettings) -> DataFrame:
    return floor_positive_columns(vm, FLOORED) if settings.floored else vm


def cluster(vm: DataFrame, variant: str = "C", partitions: int | None = None, **changes) -> tuple[MixtureFit, DataFrame]:
    """Fit one variant's mixture on a stored section table; returns the fit and the labelled rows."""
    s = MIXTURES[variant]
    rows = mixture_input(vm, s)
    options = {"k": s.k, "seed": s.seed, "max_iter": s.max_iter, "tol": s.tol, "scaled": s.scaled, **changes}
    fit = fit_mixture(rows, s.features, ["urna_id"], partitions=partitions, **options)
    return fit, fit.assign(rows)


def run(
    sources: Mapping[str, DataFrame],
    store: StageStore,
    variant: str = "C",
    fanout: str = "error",
    faithful: bool = False,
    **mixture_changes,
) -> dict[str, DataFrame | MixtureFit]:
    """The whole analysis; every stage that is read more than once is stored first."""
    wide = sections(
        bulletins(sources["bulletins"]),
        results(sources["results"]),
        machines(sources["machines"]),
        fanout,
        faithful,
    )
    # Stored, the zones have a known size: up to the threshold they are broadcast, and
    # the wide sections are not shuffled once more.
    zones = store.write("zones", zone_workers(sources["workers"]))
    vm = store.write("vm", with_zone_workers(wide, zones))
    fit, labelled = cluster(vm, variant, **mixture_changes)
    return {"vm": vm, "p": store.write("p", labelled), "fit": fit}


def export(analysis: Mapping[str, DataFrame | MixtureFit], store: StageStore, files: int = 20) -> None:
    """The stored results: sections in order of receipt, as text and per cluster, and the model."""
    write_sorted(analysis["vm"], store.path("vm_sorted"), ["dt_bu_recebido"], files)
    write_delimited(analysis["vm"], store.path("vm_csv"))
    write_partitioned(analysis["p"], store.path("p_by_cluster"), ["prediction"])
    save_mixture(analysis["fit"], store.path("mixture"))
