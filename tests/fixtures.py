"""Small source tables as Latin-1 delimited text, one case per known hazard."""

from pathlib import Path

from tallyloom import schemas

SEP, ENCODING, NULL = ";", "ISO-8859-1", "#NULO#"


def write_table(folder: Path, name: str, schema, rows, extra=("EXTRA_A", "EXTRA_B"), parts=2):
    """Columns reversed and with extra ones, so that binding by name is what is tested."""
    folder.mkdir(parents=True, exist_ok=True)
    columns = [extra[0], *reversed(schema.names), extra[1]]
    for part in range(parts):
        lines = [SEP.join(columns)]
        for row in rows[part::parts]:
            lines.append(SEP.join(str(row.get(c, "x")) for c in columns))
        (folder / f"{name}_{part}.csv").write_bytes(("\n".join(lines) + "\n").encode(ENCODING))


def bulletin(section, votable, votes, **changes):
    row = {
        "CD_CARGO_PERGUNTA": 1,
        "SG_UF": "SP",
        "CD_MUNICIPIO": "00710",
        "NM_MUNICIPIO": "SÃO PAULO",
        "NR_ZONA": "1",
        "NR_SECAO": section,
        "NR_LOCAL_VOTACAO": "1015",
        "NR_JUNTA_APURADORA": NULL,
        "NR_TURMA_APURADORA": NULL,
        "NR_URNA_EFETIVADA": 2000000,
        "DT_GERACAO": "30/10/2022",
        "HH_GERACAO": "10:11:12",
        "DT_EMISSAO_BU": "30/10/2022 17:05:00",
        "DT_BU_RECEBIDO": "30/10/2022 17:35:10",
        "DT_ABERTURA": "30/10/2022 07:30:00",
        "DT_ENCERRAMENTO": "30/10/2022 17:00:00",
        "DS_AGREGADAS": NULL,
        "NR_VOTAVEL": votable,
        "QT_VOTOS": votes,
        "QT_APTOS": 400,
        "QT_COMPARECIMENTO": 300,
        "QT_ABSTENCOES": 100,
        "QT_ELEITORES_BIOMETRIA_NH": 4,
    }
    row.update(changes)
    return row


def votes(section, a, b, blank=3, void=5, **changes):
    return [bulletin(section, v, n, **changes) for v, n in (("13", a), ("22", b), ("95", blank), ("96", void))]


def result_for(row, **changes):
    out = {
        "NR_TURNO": 2,
        "CD_MUNICIPIO": row["CD_MUNICIPIO"].lstrip("0"),
        "NR_ZONA": row["NR_ZONA"],
        "NR_SECAO": row["NR_SECAO"],
        "NR_VOTAVEL": row["NR_VOTAVEL"],
        "NM_LOCAL_VOTACAO": "COLÉGIO",
        "DS_LOCAL_VOTACAO_ENDERECO": "RUA A",
    }
    out.update(changes)
    return out


def machine_for(section, municipality="00710", zone="1", **changes):
    out = {c: "c" for c in schemas.MACHINES.names}
    out.update(
        CD_MUNICIPIO=municipality,
        NR_ZONA=zone,
        NR_SECAO=section,
        DT_CARGA_URNA_ESPERADA="20/10/2022 09:15",
        DT_CARGA_URNA_EFETIVADA=NULL,
        DT_RECO_URNA_ESPERADA="20/10/2022 09:15",
        DT_RECO_URNA_EFETIVADA="31/02/2022 09:15",
        CD_CARGA_1_URNA_ESPERADA="001234",
        DS_DIVERGENCIA=NULL,
        CD_ORIGEM_VOTO="U",
    )
    out.update(changes)
    return out


AMAZON = {"SG_UF": "AM", "CD_MUNICIPIO": "02550", "NM_MUNICIPIO": "MANAUS"}
LISTED = {"SG_UF": "AM", "CD_MUNICIPIO": "02054", "NM_MUNICIPIO": "ATALAIA"}
ACRE = {"SG_UF": "AC", "CD_MUNICIPIO": "01392", "NM_MUNICIPIO": "RIO BRANCO"}


def at(clock, **area):
    return {"DT_EMISSAO_BU": f"30/10/2022 {clock}", **area}


# section number -> (votes, changes)
SECTIONS = {
    "0001": (200, 90, {}),
    "0002": (90, 200, {"NR_URNA_EFETIVADA": 999500}),
    "0003": (150, 150, {"NR_URNA_EFETIVADA": 999499}),
    "0004": (10, 0, {"QT_APTOS": 0}),
    "0005": (10, 20, at("17:10:00")),
    "0006": (10, 20, at("17:10:01")),
    "0007": (10, 20, at("16:10:00", **AMAZON)),
    "0008": (10, 20, at("16:10:01", **AMAZON)),
    "0009": (10, 20, at("15:10:01", **LISTED)),
    "0010": (10, 20, at("15:10:00", **LISTED)),
    "0011": (10, 20, at("15:10:00", **ACRE)),
    "0012": (10, 20, at("15:10:01", **ACRE)),
    "0013": (10, 20, at("23:59:59", SG_UF="ZZ", CD_MUNICIPIO="29106", NM_MUNICIPIO="LISBOA")),
    "0014": (10, 20, {"DT_EMISSAO_BU": NULL, "DT_BU_RECEBIDO": NULL}),
    "0015": (10, 20, {"DS_AGREGADAS": "10 / 20 / 30"}),
    "0016": (0, 0, {"NR_ZONA": "2"}),
    "0017": (0, 50, {"NR_ZONA": "2", "DT_ABERTURA": "30/10/2022 08:00:00"}),
    "0018": (0, 0, {"NR_ZONA": "2", "DT_ABERTURA": "30/10/2022 06:59:59"}),
    "0019": (70, 30, {"NR_ZONA": "172", "NM_MUNICIPIO": "REGISTRO", "CD_MUNICIPIO": "69493"}),
    "0020": (60, 30, {"NR_ZONA": "172", "NM_MUNICIPIO": "REGISTRO", "CD_MUNICIPIO": "69493", "NR_URNA_EFETIVADA": 1370500}),
}
NO_MACHINE = {"0003", "0016"}


def build(repeats=False):
    bulletins, results, machines = [], [], []
    for section, (a, b, changes) in SECTIONS.items():
        rows = votes(section, a, b, **changes)
        bulletins += rows
        results += [result_for(r) for r in rows]
        if section not in NO_MACHINE:
            r = rows[0]
            spare = "#DIV" if section == "0002" else NULL
            machines.append(
                machine_for(section, r["CD_MUNICIPIO"], r["NR_ZONA"], DS_DIVERGENCIA=spare, CD_ORIGEM_VOTO="CRBX"[int(section) % 4])
            )
    # other office, other round, a votable without a result row
    bulletins.append(bulletin("0001", "13", 999, CD_CARGO_PERGUNTA=3))
    bulletins.append(bulletin("0001", "77", 999))
    results.append(result_for(bulletin("0001", "77", 0), NR_TURNO=1))
    if repeats:
        results.append(result_for(bulletin("0001", "13", 0), NM_LOCAL_VOTACAO="AAA"))
        machines.append(machine_for("0001", DS_DIVERGENCIA="#DIV"))
    workers = [
        worker("1", VOL, 7),
        worker("1", VOL, 5),
        worker("1", NOT_VOL, 11),
        worker("1", VOL, 100, TP_COMPARECIMENTO="Faltas"),
        worker("1", VOL, 1000, NR_TURNO=1),
        worker("172", NOT_VOL, 9, CD_MUNICIPIO="69493"),
    ]
    return bulletins, results, machines, workers


VOL, NOT_VOL = "Voluntárias e voluntários", "Não voluntárias e não voluntários"


def worker(zone, kind, n, **changes):
    out = {
        "NR_TURNO": 2,
        "CD_MUNICIPIO": "710",
        "NR_ZONA": zone,
        "TP_COMPARECIMENTO": "Comparecimentos",
        "TP_CONVOCACAO": kind,
        "QT_MESARIOS_PERFIL": n,
    }
    out.update(changes)
    return out


def write_all(root: Path, repeats=False):
    b, r, m, w = build(repeats)
    write_table(root / "bweb2T" / "bweb_a", "bweb", schemas.BULLETINS, b)
    write_table(root / "vs", "vs", schemas.RESULTS, r)
    write_table(root / "CEFT2T" / "SP", "ceft", schemas.MACHINES, m)
    write_table(root / "Mesarios", "mesarios", schemas.WORKERS, w, parts=1)
    (root / "Mesarios" / "mesarios_0.csv").rename(root / "Mesarios" / "mesarios_BRASIL.csv")
    write_table(root / "Mesarios", "mesarios_SP", schemas.WORKERS, w, parts=1)
    return {
        "bulletins": f"{root}/bweb2T/bweb*/*.csv",
        "results": f"{root}/vs/*.csv",
        "machines": f"{root}/CEFT2T/*/*.csv",
        "workers": f"{root}/Mesarios/*_BRASIL.csv",
    }
