"""The run-off analysis end to end on the small text fixtures."""

import pytest
from pyspark.sql import functions as F

import fixtures
from tallyloom.plans import election, reports
from tallyloom.sources import StageStore


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    return election.read_sources(spark, **fixtures.write_all(tmp_path_factory.mktemp("src")))


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    return election.read_sources(spark, **fixtures.write_all(tmp_path_factory.mktemp("rep"), repeats=True))


def prepared(s):
    return election.bulletins(s["bulletins"]), election.results(s["results"]), election.machines(s["machines"])


@pytest.fixture(scope="module")
def wide(spark, sources):
    return {r["secao"]: r for r in election.sections(*prepared(sources)).collect()}


def test_sources_keep_text_and_bind_by_name(sources):
    m = sources["machines"].first()
    assert m["CD_CARGA_1_URNA_ESPERADA"] == "001234"
    assert {r["NM_MUNICIPIO"] for r in sources["bulletins"].collect()} >= {"SÃO PAULO"}
    assert sources["workers"].count() == 6


def test_one_row_per_section_and_tallies(wide):
    assert len(wide) == len(fixtures.SECTIONS)
    for section, (a, b, _) in fixtures.SECTIONS.items():
        row = wide[section.lstrip("0")]
        assert (row["lula"], row["bolsonaro"], row["brancos"], row["nulos"]) == (a, b, 3, 5)
        assert row["lulavence"] + row["bolsonarovence"] + row["empate"] == 1
        assert row["lulavence"] == int(a > b) and row["empate"] == int(a == b)


def test_keys_join_across_padding(wide):
    assert wide["1"]["urna_id"] == "710-1-1" and wide["1"]["zona_id"] == "710-1"


def test_ratios_and_zero_denominator(wide):
    assert wide["1"]["lula_por_aptos"] == 0.5
    assert wide["1"]["tx_comparecimento"] == 0.75 and wide["1"]["abstencoes_por_aptos"] == 0.25
    assert wide["4"]["lula_por_aptos"] is None


def test_times(wide):
    row = wide["1"]
    assert str(row["dt_geracao"]) == "2022-10-30 10:11:12"
    assert row["segundos_emissao_bu_recebimento"] == 1810
    assert row["segundos_abertura_encerramento"] == -34200
    assert str(row["dt_carga_urna_esperada"]) == "2022-10-20 09:15:00"
    assert row["dt_carga_urna_efetivada"] is None and row["dt_reco_urna_efetivada"] is None
    assert wide["14"]["dt_emissao_bu"] is None and wide["14"]["segundos_emissao_bu_recebimento"] is None


def test_models(wide):
    assert [wide[s]["modelo"] for s in ("1", "2", "3", "20")] == [2020, 2009, 1, 2011]
    assert [wide[s]["modelo_2020"] for s in ("1", "2")] == [1, 0]
    assert wide["2"]["modelos_urnas"] == "2009"


def test_aggregated_sections(wide):
    assert (wide["15"]["total_secoes_agregadas"], wide["15"]["secoes_agregadas"]) == (3, "10 / 20 / 30")
    assert (wide["1"]["total_secoes_agregadas"], wide["1"]["secoes_agregadas"]) == (0, None)


def test_spare_machine_flag(wide, sources):
    assert [wide[s]["urna_contingencia"] for s in ("1", "2", "3", "16")] == [0, 1, 1, 1]
    kept = election.sections(*prepared(sources), unmatched="null")
    found = {r["secao"]: r["urna_contingencia"] for r in kept.collect()}
    assert [found[s] for s in ("1", "2", "3")] == [0, 1, None]


def test_origin_codes(wide):
    assert [wide[s]["origem_voto"] for s in ("1", "2", "4", "7")] == [2, 3, 1, None]


@pytest.mark.parametrize("faithful", [False, True])
def test_late(sources, faithful):
    rows = election.sections(*prepared(sources), faithful=faithful).collect()
    late = {r["secao"]: r["emissao_bu_pos_encerramento"] for r in rows}
    expected = {"1": 0, "5": 0, "6": 1, "7": 0, "8": 1, "9": 1, "10": 0, "11": 0, "12": 1, "13": 0, "14": 0}
    if faithful:
        expected.update({"10": 1, "11": 1})
    assert {s: late[s] for s in expected} == expected


def test_repeats_are_reported(repeated):
    b, r, m = prepared(repeated)
    with pytest.raises(Exception, match="results: several rows"):
        election.sections(b, r, m.dropDuplicates(["urna_id"])).collect()
    with pytest.raises(Exception, match="machines: several rows"):
        election.sections(b, r.dropDuplicates(["urna_id", "NR_VOTAVEL"]), m).collect()


def test_repeats_multiply_or_not(repeated, sources):
    b, r, m = prepared(repeated)
    allowed = {x["secao"]: x for x in election.sections(b, r, m, fanout="allow").collect()}
    deduped = {x["secao"]: x for x in election.sections(b, r, m, fanout="dedupe").collect()}
    assert (allowed["1"]["lula"], allowed["1"]["bolsonaro"]) == (800, 180)
    assert (deduped["1"]["lula"], deduped["1"]["bolsonaro"]) == (200, 90)
    assert allowed["1"]["aptos"] == 400 and allowed["2"]["lula"] == 90


def sections_from_detail(d, faithful=False, unmatched="one"):
    """The same wide table, folded from the multiplied detail."""
    machine = {n: (f"_m{n}" if n.startswith("_") else n) for n in election.MACHINE_ATTRIBUTES}
    wide = d.groupBy("urna_id").agg(
        election.row_pick(election.SECTION_ATTRIBUTES, "_section"),
        election.row_pick({n: n for n in election.PLACE_ATTRIBUTES}, "_place"),
        election.row_pick(machine, "_machine"),
        F.bit_or(election.label_mask("modelo", election.MODELS)).alias("_models"),
        F.max(election.late_expr("dh_emissao_bu", election.late_rules(faithful))).alias("emissao_bu_pos_encerramento"),
        *[F.max(c).alias(n) for n, c in election.LATEST.items()],
        *election.tally_columns("NR_VOTAVEL", "QT_VOTOS", election.VOTABLES),
    )
    return election._finish(wide.select("*", "_section.*", "_place.*", "_machine.*"), unmatched)


@pytest.mark.parametrize("repeats", [False, True])
def test_fold_before_join_equals_fold_of_detail(sources, repeated, repeats):
    b, r, m = prepared(repeated if repeats else sources)
    before = election.sections(b, r, m, fanout="allow")
    after = sections_from_detail(election.detail(b, r, m))
    key = lambda row: row["urna_id"]
    assert sorted(before.collect(), key=key) == sorted(after.collect(), key=key)


def test_detail_grain(sources, repeated):
    b, r, m = prepared(sources)
    assert election.detail(b, r, m).count() == 4 * len(fixtures.SECTIONS)
    b, r, m = prepared(repeated)
    # section 1: votable 13 has 2 results x 2 machine rows, the others 1 x 2
    assert election.detail(b, r, m).count() == 4 * len(fixtures.SECTIONS) + 3 + 3


def test_zone_workers(sources, wide):
    zones = {r["zona_id"]: r for r in election.zone_workers(sources["workers"]).collect()}
    assert (zones["710-1"]["voluntarios_por_zona"], zones["710-1"]["nvoluntarios_por_zona"]) == (12, 11)
    vm = election.with_zone_workers(
        election.sections(*prepared(sources)), election.zone_workers(sources["workers"])
    )
    rows = {r["secao"]: r for r in vm.collect()}
    assert (rows["1"]["voluntarios_por_zona"], rows["1"]["zona_tem_voluntarios"]) == (12, 1)
    assert (rows["17"]["voluntarios_por_zona"], rows["17"]["zona_tem_voluntarios"]) == (0, 0)
    # a zone with workers but no volunteers counts as present
    assert (rows["19"]["voluntarios_por_zona"], rows["19"]["zona_tem_voluntarios"]) == (0, 1)
    total = {r[0]: r[1] for r in election.workers_by_attendance(sources["workers"]).collect()}
    assert total == {"Comparecimentos": 32, "Faltas": 100}


@pytest.fixture(scope="module")
def analysis(spark, sources):
    return election.run(sources, StageStore(spark), k=4, max_iter=5, partitions=2)


def test_clusters(analysis):
    p = analysis["p"]
    assert p.count() == len(fixtures.SECTIONS)
    groups = [r[0] for r in p.select("prediction").distinct().collect()]
    assert set(groups) <= {0, 1, 2, 3}
    from pyspark.ml.functions import vector_to_array

    off = p.select(
        F.abs(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda x, y: x + y) - 1).alias("d")
    )
    assert off.where("d > 1e-6").count() == 0


@pytest.mark.parametrize("variant", ["V", "N"])
def test_other_variants_fit(analysis, variant):
    rows = analysis["vm"].fillna(0)
    fit, labelled = election.cluster(rows, variant, partitions=2, max_iter=3)
    assert fit.n_features == 10 and labelled.count() == len(fixtures.SECTIONS)


def test_all_comparisons(analysis):
    p, vm = analysis["p"], analysis["vm"]
    made = reports.comparisons(p, vm)
    assert len(made) == 23
    frames = {name: make().collect() for name, make in made.items()}
    total_a = p.agg(F.sum("lula")).first()[0]
    total_b = p.agg(F.sum("bolsonaro")).first()[0]
    for name in ("cmp_01", "cmp_02", "cmp_04", "cmp_05", "cmp_06", "cmp_07", "cmp_08", "cmp_09", "cmp_10"):
        assert sum(r["sum_lula"] for r in frames[name]) == total_a
        assert sum(r["sum_bolsonaro"] for r in frames[name]) == total_b
    assert {r["abertura_antes_inicio"] for r in frames["cmp_13"]} == {0, 1}
    (early,) = [r for r in frames["cmp_16"] if r["abertura_antes_inicio"] == 1]
    assert (early["sum_lula"], early["dif_rel"]) == (0, None)
    point = {r["modelo"]: r for r in frames["cmp_15"]}
    assert point[2020]["total_secoes"] == 1 and point[2020]["dif_rel"] == 1.33
    assert point[2011]["dif_abs"] == 30 and point[2011]["dif_rel"] == 1.0
    zones = {r["zona_id"]: r for r in frames["cmp_14"]}
    assert zones["69493-172"]["n_with"] == 1 and zones["69493-172"]["sum_aptos"] == 800
    won = {r["bolsonarovence"]: r for r in frames["cmp_07"]}
    assert won[1]["dif_abs"] > 0


def test_zone_size_limit_is_on_the_sum(analysis):
    from dataclasses import replace

    small = reports.comparisons(analysis["p"], analysis["vm"], replace(reports.Names(), zone_limit=799))
    assert "69493-172" not in {r["zona_id"] for r in small["cmp_14"]().collect()}


def test_all_crosstabs(analysis):
    p = analysis["p"]
    n = p.count()
    tables = reports.crosstabs(p)
    assert len(tables) == 12
    for make in tables.values():
        rows = make().collect()
        assert sum(sum(r[1:]) for r in rows) == n
    long = reports.crosstabs(p, wide=False)["xt_01"]().collect()
    assert sum(r["n"] for r in long) == n


@pytest.mark.parametrize("variant,plots", [("V", 12), ("N", 12), ("C", 18)])
def test_all_distributions(analysis, variant, plots):
    specs = reports.distribution_specs()[variant]
    assert len(specs) == plots
    made = reports.distributions(analysis["p"], variant=variant)
    assert len(made) == plots
    one = next(v for k, v in made.items() if k.endswith("lulavence"))()
    assert sum(r["n"] for r in one["cells"].collect()) == sum(r["n"] for r in one["marginal_x"].collect())


def test_top_shares(analysis):
    rows = reports.top_shares(analysis["p"], ["secao", "lula_por_aptos"], limit=3).collect()
    shares = [r["lula_por_aptos"] for r in rows]
    assert shares == sorted(shares, reverse=True) and len(rows) <= 3


def test_exports(spark, analysis):
    store = StageStore(spark)
    election.export(analysis, store, files=3)
    n = len(fixtures.SECTIONS)
    assert store.read("vm_sorted").count() == store.read("p_by_cluster").count() == n
    assert spark.read.options(header=True, sep=";").csv(store.path("vm_csv")).count() == n


def test_stored_reports(spark, analysis):
    store = StageStore(spark)
    p = store.write("p", analysis["p"])
    assert len(reports.write_reports(p, analysis["vm"], store, variant="V")) == 23 + 12 + 3 * 12
    assert store.read("cmp_09").count() > 1 and store.read("plot_0_regiao_cells").columns[0] == "regiao"


def test_stored_zones_are_broadcast(spark, sources):
    store = StageStore(spark)
    wide = store.write("wide", election.sections(*prepared(sources)))
    zones = store.write("zones", election.zone_workers(sources["workers"]))
    plan = election.with_zone_workers(wide, zones)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_the_fold_of_bulletins_sorts_no_parsed_times(sources):
    """What the fold works out itself does not widen the rows that it sorts."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    plan = election.sections(*prepared(sources))._jdf.queryExecution().optimizedPlan()
    folds = [n for n in nodes(plan) if n.nodeName() == "Aggregate" and "QT_VOTOS" in n.references().toString()]
    assert len(folds) == 1
    read = folds[0].child().output()
    names = {read.apply(i).name(): read.apply(i).dataType().simpleString() for i in range(read.size())}
    assert "timestamp_ntz" not in names.values() and "modelo" not in names
