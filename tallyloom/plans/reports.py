"""The reports over a clustered section table, stated as data.

``Names`` says which column plays which part, so the same reports run on any
table of that shape.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import before_cutoff_flag
from ..operators import (
    CELLS,
    ROWS,
    Folds,
    compare_by,
    crosstab_long,
    crosstab_wide,
    having_mixed_groups,
    joint_distribution,
    sample_projection,
    share_by,
    sum_pair_by_group,
    top_n,
)
from ..operators.rollup import Rows
from ..sources import StageStore, write_parquet


@dataclass(frozen=True)
class Names:
    """Columns of the section table."""

    a: str = "lula"
    b: str = "bolsonaro"
    share_a: str = "lula_por_aptos"
    share_b: str = "bolsonaro_por_aptos"
    eligible: str = "aptos"
    group: str = "prediction"
    model: str = "modelo"
    new_model: str = "modelo_2020"
    late: str = "emissao_bu_pos_encerramento"
    spare: str = "urna_contingencia"
    a_wins: str = "lulavence"
    b_wins: str = "bolsonarovence"
    tie: str = "empate"
    region: str = "regiao"
    state: str = "uf"
    zone: str = "zona_id"
    has_workers: str = "zona_tem_voluntarios"
    opened: str = "dt_abertura"
    key: str = "urna_id"
    zone_labels: tuple[str, ...] = ("cidade", "uf", "zona")
    point: tuple[tuple[str, object], ...] = (("zona", "172"), ("cidade", "REGISTRO"), ("uf", "SP"))
    no_model: object = 1
    models: tuple[int, ...] = (1, 2009, 2010, 2011, 2013, 2015, 2020)
    abroad: object = "ZZ"
    opening: str = "2022-10-30 08:00:00"
    early_opening: str = "2022-10-30 07:00:00"
    zone_limit: int = 50000
    others: tuple[int, ...] = (0, 1, 2)
    last_group: int = 3


def _point(n: Names) -> Column:
    condition = F.lit(True)
    for column, value in n.point:
        condition = condition & (F.col(column) == F.lit(value))
    return condition


def derived_dims(n: Names) -> dict[str, Column]:
    """Dims of reports that are no columns of the section table."""
    return {
        "opened_before_start": before_cutoff_flag(n.opened, n.opening),
        "opened_early": before_cutoff_flag(n.opened, n.early_opening),
        "at_point": _point(n),
    }


def _comparisons(
    table: Callable[[str, set[str]], DataFrame], derived: Mapping[str, Column], n: Names, digits: int, of: Rows
) -> dict[str, Callable[[], DataFrame]]:
    """The comparisons over ``table(name, columns)``, which gives "p" or "vm" with at least these columns."""
    known = F.col(n.model) != n.no_model
    home = F.col(n.region) != n.abroad

    def by(dims, where=None, reads=(), name="p", **options):
        columns = {dims, *reads} if isinstance(dims, str) else set(reads)
        return lambda: compare_by(table(name, columns), dims, n.a, n.b, where=where, digits=digits, of=of, **options)

    def share(dim):
        return lambda: share_by(table("p", {dim}), dim, n.a, n.b, n.eligible, digits=digits, of=of)

    def opened(dim):
        return by({"abertura_antes_inicio": derived[dim]}, home, {dim, n.region})

    def pair(dim, name="p", **options):
        return lambda: sum_pair_by_group(table(name, {dim}), dim, n.a, n.b, of=of, **options)

    model, both = {n.model}, {n.model, n.group}
    return {
        "cmp_01": by(n.group),
        "cmp_02": by(n.new_model),
        "cmp_03": by(n.model, known),
        "cmp_04": by(n.late),
        "cmp_05": by(n.spare),
        "cmp_06": by(n.a_wins),
        "cmp_07": by(n.b_wins, reverse=True),
        "cmp_08": by(n.tie),
        "cmp_09": by(n.region),
        "cmp_10": by(n.state),
        "cmp_11": share(n.new_model),
        "cmp_12": share(n.model),
        "cmp_13": opened("opened_before_start"),
        "cmp_14": lambda: having_mixed_groups(
            table("p", {n.zone, n.new_model}),
            n.zone,
            n.a,
            n.b,
            n.zone_labels,
            n.eligible,
            n.zone_limit,
            n.new_model,
            digits=digits,
            of=of,
        ),
        "cmp_15": by(n.model, derived["at_point"], {"at_point"}, count="total_secoes"),
        "cmp_16": opened("opened_early"),
        "cmp_17": by(n.model, known & F.col(n.group).isin(list(n.others)), both),
        "cmp_18": by(n.model, known & (F.col(n.group) == n.last_group), both),
        "cmp_19": by(n.new_model, known & (F.col(n.group) != n.last_group), both),
        "cmp_20": by(n.new_model, known & (F.col(n.group) == n.last_group), both),
        "cmp_21": by(n.new_model, known, model, name="vm", stddev=True),
        "cmp_22": pair(n.group, where=F.col(n.group) == 0),
        "cmp_23": pair(n.new_model, name="vm", total=True),
    }


def comparisons(p: DataFrame, vm: DataFrame, n: Names = Names(), digits: int = 2) -> dict[str, Callable[[], DataFrame]]:
    """The grouped comparison reports; call an entry to get its DataFrame."""
    return _comparisons(lambda name, columns: vm if name == "vm" else p, derived_dims(n), n, digits, ROWS)


@dataclass
class ReportFolds:
    """Folds of the section tables that answer every comparison and contingency table."""

    p: Folds
    vm: Folds
    n: Names

    def comparisons(self, digits: int = 2) -> dict[str, Callable[[], DataFrame]]:
        def table(name, columns):
            return (self.vm if name == "vm" else self.p).smallest(columns)

        return _comparisons(table, {d: F.col(d) for d in derived_dims(self.n)}, self.n, digits, CELLS)

    def crosstabs(self, values: Mapping[str, list] | None = None, wide: bool = True) -> dict[str, Callable[[], DataFrame]]:
        return _crosstabs(self.p.smallest, self.n, values, wide, CELLS)


def fold_reports(p: DataFrame, vm: DataFrame, store: StageStore, n: Names = Names()) -> ReportFolds:
    """Read ``p`` and ``vm`` once each, and store the cells of their reports.

    Zones are many and have a set of their own; the flags that contingency tables pair have another one, smaller than that of all dims.
    """
    pairs = crosstab_pairs(n).values()
    flags = dict.fromkeys(c for rows, columns, _ in pairs for c in (rows, columns))
    single = dict.fromkeys([*flags, n.b_wins, n.tie, n.state, *derived_dims(n)])
    dims = {c: c for c in [*single, n.zone] if c not in derived_dims(n)} | derived_dims(n)
    sets = [
        [n.zone, n.new_model],
        [n.group, n.model, n.new_model],
        [n.region, *derived_dims(n), n.model],
        [n.late, n.spare, n.a_wins, n.b_wins, n.tie, n.has_workers, n.new_model, n.group],
        [n.region, n.a_wins, n.new_model, n.group],
        [n.state],
    ]
    folded = Folds.store(store, "folds_p", p, dims, sets, sums=[n.a, n.b, n.eligible], maxima=list(n.zone_labels))
    whole = Folds.store(
        store, "folds_vm", vm, {n.new_model: n.new_model, n.model: n.model}, [[n.new_model, n.model]], squares=[n.a, n.b]
    )
    return ReportFolds(folded, whole, n)


def crosstab_pairs(n: Names = Names()) -> dict[str, tuple[str, str, bool]]:
    """(rows, columns, ordered) of each contingency table."""
    return {
        "xt_01": (n.region, n.group, False),
        "xt_02": (n.group, n.new_model, True),
        "xt_03": (n.group, n.model, True),
        "xt_04": (n.spare, n.group, False),
        "xt_05": (n.late, n.group, False),
        "xt_06": (n.a_wins, n.group, False),
        "xt_07": (n.region, n.a_wins, False),
        "xt_08": (n.new_model, n.a_wins, False),
        "xt_09": (n.late, n.a_wins, False),
        "xt_10": (n.region, n.new_model, False),
        "xt_11": (n.has_workers, n.a_wins, False),
        "xt_12": (n.has_workers, n.b_wins, False),
    }


def crosstab_values(n: Names = Names(), groups: int = 4) -> dict[str, list]:
    """The values that become columns; all others are counted in the column ``other``."""
    flags = dict.fromkeys((n.new_model, n.a_wins, n.b_wins), [0, 1])
    return {n.group: list(range(groups)), n.model: list(n.models), **flags}


def _crosstabs(
    table: Callable[[set[str]], DataFrame], n: Names, values: Mapping[str, list] | None, wide: bool, of: Rows
) -> dict[str, Callable[[], DataFrame]]:
    stated = {**crosstab_values(n), **(values or {})}

    def make(rows, columns, ordered):
        if not wide:
            return lambda: crosstab_long(table({rows, columns}), rows, columns, of=of)
        return lambda: crosstab_wide(table({rows, columns}), rows, columns, stated[columns], ordered=ordered, of=of)

    return {name: make(*spec) for name, spec in crosstab_pairs(n).items()}


def crosstabs(
    p: DataFrame, n: Names = Names(), values: Mapping[str, list] | None = None, wide: bool = True
) -> dict[str, Callable[[], DataFrame]]:
    """The contingency tables. ``values`` replaces the column values of ``crosstab_values`` per column."""
    return _crosstabs(lambda columns: p, n, values, wide, ROWS)


def distribution_specs(n: Names = Names()) -> dict[str, list[tuple[int | None, str, float]]]:
    """(group or None for all, hue, sampled fraction) of each joint plot, per variant."""
    first = [(0, h) for h in (n.a_wins, n.new_model, n.region, n.late, n.spare)]
    first += [(1, h) for h in (n.a_wins, n.region, n.model)]
    first += [(2, h) for h in (n.a_wins, n.region)]
    last = [(3, h) for h in (n.a_wins, n.region)]
    cloud = [(0, h, 1.0) for h in (n.model, n.region, n.late, n.a_wins)]
    cloud += [(1, h, 1.0) for h in (n.new_model, n.a_wins, n.region, n.model)]
    cloud += [(2, h, 1.0) for h in (n.a_wins, n.region, n.new_model, n.model)]
    cloud += [(3, h, 0.1) for h in (n.a_wins, n.region, n.new_model, n.model, n.late)]
    return {
        "V": [(g, h, 0.1) for g, h in first] + [(g, h, 1.0) for g, h in last],
        "N": [(g, h, 0.1) for g, h in first + last],
        "C": [(None, n.group, 0.1)] + cloud,
    }


def distribution_name(group: int | None, hue: str) -> str:
    return f"{'all' if group is None else group}_{hue}"


def distributions(
    p: DataFrame, n: Names = Names(), variant: str = "C", width: float = 0.02, seed: int = 42
) -> dict[str, Callable[[], dict[str, DataFrame]]]:
    """The joint plots of a variant; call an entry to get its cells, levels and marginals."""

    def plot(group, hue, fraction):
        where = None if group is None else F.col(n.group) == group
        if (group, hue) == (1, n.model) and variant == "C":
            where = where & (F.col(n.model) != n.no_model)

        def layers():
            points = sample_projection(p, [n.share_b, n.share_a, hue], [n.key], where, fraction, seed)
            return joint_distribution(points, n.share_a, n.share_b, hue, width)

        return layers

    return {distribution_name(g, h): plot(g, h, f) for g, h, f in distribution_specs(n)[variant]}


def top_shares(p: DataFrame, columns: list[str], n: Names = Names(), limit: int = 100000) -> DataFrame:
    """Sections with the largest share of ``a`` among those of old models outside the last group."""
    where = (
        F.col(n.share_a).between(0.0, 1.0) & (F.col(n.group) != n.last_group) & (F.col(n.new_model) == 0)
    )
    return top_n(p, n.share_a, limit, [n.key], where, bounds=(0.0, 1.0)).select(*columns)


def write_reports(p: DataFrame, vm: DataFrame, store: StageStore, n: Names = Names(), variant: str = "C") -> list[str]:
    """Store every comparison, contingency table and joint plot under its name.

    ``p`` and ``vm`` are read once each for all comparisons and contingency tables.
    """
    folds = fold_reports(p, vm, store, n)
    made = {**folds.comparisons(), **folds.crosstabs()}
    for name, make in made.items():
        write_parquet(make(), store.path(name))
    written = list(made)
    for name, layers in distributions(p, n, variant).items():
        for layer, df in layers().items():
            written.append(f"plot_{name}_{layer}")
            write_parquet(df, store.path(written[-1]))
    return written
