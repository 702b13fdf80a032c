"""Reference SQL (DuckDB dialect) of the registered queries, written independently of the operators."""

from __future__ import annotations

# Fixed values, spelled out here again so that a wrong one in the operators shows.
_IGG_CUT = {
    "pfmsp1": 150, "ama1": 209, "glurp0": 169, "csp": 362, "hrp2": 337, "lsa1": 124, "pmmsp1": 550, "pomsp1": 362,
    "pvmsp1": 193,
}
_ANTIGEN_CUT = {"hrp2_a": 633, "paldo": 1865, "pldh": 430, "pvldh": 600}
_SPECIES = {
    "1": (1, 0, 0), "2 (Pf Pm)": (1, 1, 0), "2 (Pf PO)": (1, 0, 1), "2(Pf Pm)": (1, 1, 0), "3 (Pf Pm PO)": (1, 1, 1),
    "3 (Pf PM PO)": (1, 1, 1), "1 (Pm)": (0, 1, 0), "1 (PO)": (0, 0, 1), "PO": (0, 0, 1), "Pm": (0, 1, 0),
    "2 (Pm PO)": (0, 1, 1),
}
_SELECTION = ["Zones", "pAldolase", "pLDH", "pLDH+/HRP2-", "PvLDH"]
_EXPORTED = """
ptid varstrat varunit a1qnumber hh_id a1q120 hhwgt ahmember ab_wt ag_wt ahzone ahstate ahlga age
agegrp gender ahtype wealthquintile a1q119 a1q115 a1q108 a1q109 a1q105n a1q105a a1q101a
pfmsp1 pvmsp1 pomsp1 pmmsp1 ama1 glurp0 csp hrp2 lsa1 hrp2_a
pfmsp1pos pmmsp1pos pomsp1pos pvmsp1pos ama1pos glurppos csppos hrp2pos lsa1pos
hrp2_pos pldh_pos pvldh_pos paldo_pos
""".split()

_PERSON = """
person AS (
SELECT o.o_orderkey AS ptid, c.c_nationkey AS varstrat, o.o_custkey AS varunit,
       CAST(o.o_orderkey % 3 AS INT) AS a1qnumber, o.o_custkey * 10 + o.o_orderkey % 3 AS hh_id,
       o.o_totalprice / 500 AS hhwgt, o.o_totalprice / 1000 AS ab_wt, o.o_totalprice / 2000 AS ag_wt,
       c.c_nationkey AS ahstate, n.n_regionkey AS ahzone, CAST(o.o_orderkey % 12 AS INT) AS ahlga,
       CAST(o.o_orderkey % 15 AS INT) AS age,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 2 END AS gender,
       CAST(1 + o.o_custkey % 2 AS INT) AS ahtype,
       CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS wealthquintile,
       CAST(2 + o.o_custkey % 9 AS INT) AS ahmember,
       CAST(CASE WHEN o.o_orderkey % 20 = 0 THEN NULL WHEN o.o_orderkey % 20 = 1 THEN 8
            WHEN o.o_orderkey % 20 = 2 THEN 9 ELSE 1 + o.o_orderkey % 2 END AS INT) AS a1q119,
       CAST(CASE WHEN o.o_orderkey % 20 > 2 AND o.o_orderkey % 2 = 0 THEN 1 + o.o_orderkey % 5 END AS INT)
            AS a1q120,
       CAST(CASE WHEN o.o_custkey % 20 = 0 THEN NULL WHEN o.o_custkey % 20 = 1 THEN 8
            WHEN o.o_custkey % 20 = 2 THEN 9 ELSE 1 + o.o_custkey % 2 END AS INT) AS a1q115,
       CAST(CASE WHEN (o.o_orderkey // 4) % 20 = 0 THEN NULL WHEN (o.o_orderkey // 4) % 20 = 1 THEN 8
            WHEN (o.o_orderkey // 4) % 20 = 2 THEN 9 ELSE 1 + (o.o_orderkey // 4) % 2 END AS INT) AS a1q105n,
       CAST(CASE WHEN (o.o_orderkey // 8) % 20 = 0 THEN NULL WHEN (o.o_orderkey // 8) % 20 = 1 THEN 8
            WHEN (o.o_orderkey // 8) % 20 = 2 THEN 9 ELSE 1 + (o.o_orderkey // 8) % 2 END AS INT) AS a1q105a,
       CAST(CASE WHEN o.o_orderkey % 11 = 10 THEN 9 ELSE 1 + o.o_orderkey % 3 END AS INT) AS a1q101a,
       CAST(CASE WHEN o.o_orderkey % 17 = 16 THEN 96 WHEN o.o_orderkey % 17 = 15 THEN 97
            ELSE 10 + o.o_orderkey % 30 END AS INT) AS a1q108,
       CAST(CASE WHEN o.o_orderkey % 19 = 18 THEN 96 WHEN o.o_orderkey % 19 = 17 THEN 97
            ELSE 8 + o.o_orderkey % 31 END AS INT) AS a1q109,
       l.*,
       CASE WHEN (o.o_orderkey * 7919) % 1000 < 600 * (1 - exp(-0.2 * (o.o_orderkey % 15))) THEN 1 ELSE 0 END
            AS pmpos,
       CASE WHEN (o.o_orderkey * 6101) % 1000 < 300 * (1 - exp(-0.1 * (o.o_orderkey % 15))) THEN 1 ELSE 0 END
            AS popos
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, avg(l_extendedprice) / 50 AS pmmsp1, min(l_extendedprice) / 50 - 100 AS pomsp1,
                  max(l_extendedprice) / 500 AS pvmsp1, sum(l_extendedprice) / 500 AS pfmsp1,
                  avg(l_extendedprice * l_discount) / 4 AS hrp2_1, sum(l_quantity) * 2 AS gst,
                  avg(l_extendedprice) / 200 AS ama1, max(l_extendedprice) / 200 AS csp,
                  min(l_extendedprice) / 100 AS glurp0, sum(l_extendedprice * l_discount) / 20 AS hrp2,
                  avg(l_quantity) * 5 AS lsa1, max(l_extendedprice) / 35 AS paldo,
                  min(l_extendedprice) / 40 AS pldh, sum(l_extendedprice * l_tax) / 8 AS pvldh
           FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey)"""

_IGG = {**{s: f"{s}pos" for s in _IGG_CUT}, "glurp0": "glurppos"}
_ANTIGEN = {"hrp2_a": ("hrp2_1", "hrp2_pos"), "paldo": ("paldo", "paldo_pos"),
            "pldh": ("pldh", "pldh_pos"), "pvldh": ("pvldh", "pvldh_pos")}
_AGE3 = ("CASE WHEN age >= 0 AND age < 5 THEN 1 WHEN age >= 5 AND age < 10 THEN 2 "
         "WHEN age >= 10 AND age < 15 THEN 3 END")
_AGE7 = ("CASE WHEN age < 3 THEN 1 WHEN age < 5 THEN 2 WHEN age < 7 THEN 3 WHEN age < 9 THEN 4 "
         "WHEN age < 11 THEN 5 WHEN age < 13 THEN 6 WHEN age <= 14 THEN 7 END")
_YESNO = "CASE {0} WHEN 1 THEN 1 WHEN 2 THEN 0 END"
_NETS = "CASE WHEN a1q119 = 2 THEN 0 WHEN a1q119 <> 2 THEN a1q120 END"

_FLAGGED = f"""
flagged AS (SELECT *, {_AGE3} AS agegrp, {_AGE7} AS agegrp7,
  CAST(ahstate AS VARCHAR) || CASE WHEN ahlga < 10 THEN '0' || CAST(ahlga AS VARCHAR)
     ELSE CAST(ahlga AS VARCHAR) END AS lga_text,
  {", ".join(f"CASE WHEN {s} > {_IGG_CUT[s]} THEN 1 ELSE 0 END AS {f}" for s, f in _IGG.items())},
  {", ".join(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} > {_ANTIGEN_CUT[a]} THEN 1 ELSE 0 END AS {f}"
             for a, (c, f) in _ANTIGEN.items())}
FROM person),
keyed AS (SELECT *, CAST(lga_text AS INT) AS lga FROM flagged)"""

_NET = f"""
netted AS (SELECT *, num_nets / CAST(ahmember AS DOUBLE) AS netratio FROM
   (SELECT *, {_NETS} AS num_nets FROM keyed)),
owned AS (SELECT *, CASE WHEN netratio >= 0.556 THEN 1 WHEN netratio < 0.556 THEN 0 END AS net1_8 FROM netted),
covered AS (SELECT *, CAST(count(*) OVER (PARTITION BY varunit) AS BIGINT) AS n_clust,
   CAST(coalesce(sum(net1_8) OVER (PARTITION BY varunit), 0) AS BIGINT) AS n_net FROM owned)"""

_SPECIES_VALUES = ", ".join(
    f"('{s}', {pf}, {pm}, {po})" for s, (pf, pm, po) in _SPECIES.items()
)
_TEXTS = [*_SPECIES, None, "unknown"]
_CRITERIA = [*_SELECTION, "Other"]


def _pick(expr: str, values: list) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {cases} END"


_SAMPLES = f"""
decode(species, pf, pm, po) AS (VALUES {_SPECIES_VALUES}),
lab0 AS (SELECT o_orderkey AS ptid, o_custkey + 100000 AS cluster,
   {_pick(f"o_orderkey % {len(_TEXTS)}", _TEXTS)} AS species_present,
   CASE WHEN o_orderkey % 50 = 0 THEN 'missing' END AS missing_samples,
   {_pick(f"o_orderkey % {len(_CRITERIA)}", _CRITERIA)} AS selection_criteria
   FROM orders JOIN customer ON o_custkey = c_custkey WHERE {{which}}),
lab AS (SELECT lab0.*, coalesce(species_present, '0') AS pcr_species,
   coalesce(pf, 0) AS pcr_pf, coalesce(pm, 0) AS pcr_pm, coalesce(po, 0) AS pcr_po,
   CASE WHEN coalesce(species_present, '0') = '1' THEN 1 ELSE 0 END AS pcr_pfmono,
   CASE WHEN species_present IN ('1 (Pm)', 'Pm', '2 (Pf Pm)', '2(Pf Pm)') THEN 1 ELSE 0 END AS pcr_pm_pf,
   CASE WHEN species_present IN ('2 (Pf PO)', '1 (PO)', 'PO') THEN 1 ELSE 0 END AS pcr_po_pf,
   CASE WHEN selection_criteria = 'Zones' THEN 1
        WHEN selection_criteria IN ('pAldolase', 'pLDH', 'pLDH+/HRP2-', 'PvLDH') THEN 2 END AS selection_cri
   FROM lab0 LEFT JOIN decode ON species_present = species)"""

_LAB = _SAMPLES.replace("{which}", "c_mktsegment = 'BUILDING'")
_ALL_SAMPLES = _SAMPLES.replace("{which}", "true")

_WEIGHTED = """
weighted AS (SELECT *, ab_wt * count(*) OVER (PARTITION BY varunit) / sum(ab_wt) OVER (PARTITION BY varunit)
   AS wt FROM keyed)"""

BASE = f"WITH {_PERSON}, {_FLAGGED}"
NET = f"{BASE}, {_NET}"
LAB = f"{BASE}, {_LAB}"
ALL_SAMPLES = f"{BASE}, {_ALL_SAMPLES}"
WEIGHTED = f"{BASE}, {_WEIGHTED}"

Z = "1.959963984540054"
MSP1_POS = ["pmmsp1pos", "pomsp1pos", "pvmsp1pos", "pfmsp1pos"]


def _long(outcomes: list[str], domain: str, source: str = "weighted", strata: str = "varstrat") -> str:
    """One row per person and outcome: dom, outcome, h, i, wt, y."""
    return " UNION ALL ".join(
        f"SELECT {domain}, '{o}' AS outcome, {strata} AS h, varunit AS i, wt, CAST({o} AS DOUBLE) AS y "
        f"FROM {source} WHERE {o} IS NOT NULL"
        for o in outcomes
    )


def _variance(long: str, keys: str, stat: str = "mean", source: str = "weighted", strata="varstrat") -> str:
    """Common table expressions ending in ``est(keys, n, estimate, se)`` from explicit scores."""
    k = [x.strip() for x in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in k)
    cols = lambda a: ", ".join(f"{a}.{c}" for c in k)
    score = "wt * (y - dom.sy / dom.sw) / dom.sw" if stat == "mean" else "wt * y"
    est = "dom.sy / dom.sw" if stat == "mean" else "dom.sy"
    return f"""
long AS ({long}),
psus AS (SELECT {strata} AS h, count(DISTINCT varunit) AS nh FROM {source} GROUP BY 1),
grand AS (SELECT sum(nh) AS np, sum(CASE WHEN nh = 1 THEN 1 ELSE 0 END) AS nl FROM psus),
dom AS (SELECT {keys}, count(*) AS n, sum(wt) AS sw, sum(wt * y) AS sy FROM long GROUP BY {keys}),
z AS (SELECT {cols("long")}, h, i, sum({score}) AS z FROM long JOIN dom ON {on("long", "dom")}
      GROUP BY {cols("long")}, h, i),
zbar AS (SELECT {keys}, sum(z) / (SELECT np FROM grand) AS zb FROM z GROUP BY {keys}),
zh AS (SELECT {cols("z")}, z.h, nh, sum(z) AS s1, sum(z * z) AS s2, sum((z - zb) * (z - zb)) AS sc
       FROM z JOIN psus ON z.h = psus.h JOIN zbar ON {on("z", "zbar")} GROUP BY {cols("z")}, z.h, nh),
var AS (SELECT {keys}, sum(CASE WHEN nh > 1 THEN nh / (nh - 1.0) * (s2 - s1 * s1 / nh) ELSE sc END) AS v,
        sum(CASE WHEN nh = 1 THEN 1 ELSE 0 END) AS seen FROM zh GROUP BY {keys}),
est AS (SELECT {cols("dom")}, dom.n, {est} AS estimate,
        sqrt(v + ((SELECT nl FROM grand) - seen) * zb * zb) AS se
        FROM dom JOIN var ON {on("dom", "var")} JOIN zbar ON {on("dom", "zbar")})"""


def _ci(digits: int, se: str = "se") -> str:
    return (f"round(estimate - {Z} * se, {digits}) AS ci_low, "
            f"round(estimate + {Z} * se, {digits}) AS ci_high")


def _t_point(df: str) -> str:
    """The 97.5 % point of Student's t by its expansion in 1 / df around the normal point."""
    return (f"({Z} + ({Z} ^ 3 + {Z}) / (4 * {df}) + (5 * {Z} ^ 5 + 16 * {Z} ^ 3 + 3 * {Z}) / (96 * {df} ^ 2) "
            f"+ (3 * {Z} ^ 7 + 19 * {Z} ^ 5 + 17 * {Z} ^ 3 - 15 * {Z}) / (384 * {df} ^ 3))")


def _dup(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


_SQUARES = """
sq AS (SELECT c_custkey AS area_id, c_custkey % 40 AS gx, c_custkey // 40 AS gy FROM customer)"""
_EDGES = """
edges AS (SELECT a.area_id AS src, b.area_id AS dst FROM sq a JOIN sq b
   ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.area_id <> b.area_id)"""

_EB = f"""{WEIGHTED}, {_SQUARES}, {_EDGES},
hood AS (SELECT * FROM edges UNION ALL SELECT area_id, area_id FROM sq),
cnt AS (SELECT varunit AS area_id, CAST(count(*) AS DOUBLE) AS n, sum(wt * pmpos) AS n_pmpos,
        sum(wt * popos) AS n_popos FROM weighted GROUP BY 1),
member AS (SELECT area_id, 'n_pmpos' AS outcome, n, n_pmpos AS r FROM cnt
           UNION ALL SELECT area_id, 'n_popos', n, n_popos FROM cnt),
local AS (SELECT src AS area_id, outcome, sum(r) / sum(n) AS m, sum(n) AS sn, count(*) AS k
          FROM hood JOIN member ON dst = area_id GROUP BY 1, 2),
spread AS (SELECT h.src AS area_id, x.outcome, sum(x.n * power(x.r / x.n - lo.m, 2)) AS c
           FROM hood h JOIN member x ON h.dst = x.area_id
           JOIN local lo ON lo.area_id = x.area_id AND lo.outcome = x.outcome GROUP BY 1, 2),
shrunk AS (SELECT x.*, x.r / x.n AS raw, m, greatest(0, c / sn - m / (sn / k)) AS a
           FROM member x JOIN local USING (area_id, outcome) JOIN spread USING (area_id, outcome)),
eb AS (SELECT area_id, outcome, n, r, raw,
       CASE WHEN a + m / n = 0 THEN m ELSE m + (raw - m) * a / (a + m / n) END AS est FROM shrunk)"""

_STRATA = ["gender", "ahtype", "wealthquintile", "ahstate"]


def _sero_counts(strata: list[str]) -> str:
    parts = []
    for o in ("pmpos", "popos"):
        for s, level in [("overall", "'all'"), *[(s, f"CAST({s} AS VARCHAR)") for s in strata]]:
            parts.append(
                f"SELECT '{o}' AS antigen, '{s}' AS stratifier, {level} AS level, age, "
                f"CAST(count({o}) AS BIGINT) AS n, CAST(sum({o}) AS BIGINT) AS k FROM person "
                "WHERE age > 0 GROUP BY 1, 2, 3, 4"
            )
    return " UNION ALL ".join(parts)


_CELLS = 60
_LO, _HI = "ln(0.001)", "ln(10.0)"
_AXIS = f"exp({_LO} + ({{0}}) * ({_HI} - {_LO}) / {_CELLS}.0)"
_GRID = f"""{BASE}, counts AS ({_sero_counts(["ahzone"])}),
cells AS (SELECT a.range AS i, b.range AS j, {_AXIS.format("a.range + 0.5")} AS lam,
          {_AXIS.format("b.range + 0.5")} AS rho FROM range({_CELLS}) a, range({_CELLS}) b),
ll AS (SELECT antigen, stratifier, level, i, j, lam, rho,
       sum(k * ln(lam / (lam + rho) * (1 - exp(-(lam + rho) * age)))
           + (n - k) * ln(1 - lam / (lam + rho) * (1 - exp(-(lam + rho) * age)))) + ln(lam) + ln(rho) AS logw
       FROM counts, cells GROUP BY antigen, stratifier, level, i, j, lam, rho),
w AS (SELECT *, exp(logw - max(logw) OVER (PARTITION BY antigen, stratifier, level)) AS w FROM ll),
marg0 AS (SELECT antigen, stratifier, level, 'lambda' AS parameter, i AS cell, sum(w) AS w FROM w GROUP BY ALL
          UNION ALL
          SELECT antigen, stratifier, level, 'rho' AS parameter, j AS cell, sum(w) AS w FROM w GROUP BY ALL),
marg AS (SELECT antigen, stratifier, level, parameter, CAST(cell AS INT) AS cell,
         {_AXIS.format("cell")} AS low, {_AXIS.format("cell + 1")} AS high,
         w / sum(w) OVER p AS mass,
         coalesce(sum(w) OVER (PARTITION BY antigen, stratifier, level, parameter ORDER BY cell
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(w) OVER p, 0) AS before
         FROM marg0 WINDOW p AS (PARTITION BY antigen, stratifier, level, parameter)),
post AS (SELECT antigen, stratifier, level, parameter,
         {", ".join(f'''max(CASE WHEN before < {p} AND before + mass >= {p}
             THEN low + ({p} - before) / mass * (high - low) END) AS {n}'''
             for p, n in ((0.025, "low"), (0.5, "median"), (0.975, "high")))}
         FROM marg GROUP BY ALL)"""


def _pass(n: int, cells: int = 200) -> str:
    """Marginals over a log grid of the box of every group: ``box{n}`` to ``marg{n}``."""
    group = "antigen, stratifier, level"
    axis = lambda a, i: f"exp({a}_lo + ({i}) * ({a}_hi - {a}_lo) / {cells}.0)"
    side = lambda name, a, i: (
        f"SELECT {group}, '{name}' AS parameter, {i} AS cell, {axis(a, i)} AS low, {axis(a, f'{i} + 1')} AS high, "
        f"sum(w) AS w FROM w{n} JOIN box{n} USING ({group}) GROUP BY ALL")
    return f"""cells{n} AS (SELECT {group}, a.range AS i, b.range AS j, {axis("lam", "a.range + 0.5")} AS lam,
        {axis("rho", "b.range + 0.5")} AS rho FROM box{n}, range({cells}) a, range({cells}) b),
    ll{n} AS (SELECT {group}, i, j, sum(k * ln(lam / (lam + rho) * (1 - exp(-(lam + rho) * age)))
        + (n - k) * ln(1 - lam / (lam + rho) * (1 - exp(-(lam + rho) * age)))) + ln(lam) + ln(rho) AS logw
        FROM counts JOIN cells{n} USING ({group}) GROUP BY {group}, i, j, lam, rho),
    w{n} AS (SELECT {group}, i, j, exp(logw - max(logw) OVER (PARTITION BY {group})) AS w FROM ll{n}),
    side{n} AS ({side("lambda", "lam", "i")} UNION ALL {side("rho", "rho", "j")}),
    marg{n} AS (SELECT {group}, parameter, CAST(cell AS INT) AS cell, low, high, w / sum(w) OVER p AS mass,
        coalesce(sum(w) OVER (PARTITION BY {group}, parameter ORDER BY cell
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(w) OVER p, 0) AS before
        FROM side{n} WINDOW p AS (PARTITION BY {group}, parameter))"""


# the grid as the engine fills it: 200 cells an axis from 1e-5, then 200 over what holds all but 1e-5 of each tail
_FINE = f"""{BASE}, counts AS ({_sero_counts(["ahzone"])}),
box1 AS (SELECT DISTINCT antigen, stratifier, level, ln(0.00001) AS lam_lo, ln(10.0) AS lam_hi, ln(0.00001) AS rho_lo,
    ln(10.0) AS rho_hi FROM counts), {_pass(1)},
box2 AS (SELECT antigen, stratifier, level, {", ".join(
    f"ln(min(low) FILTER (parameter = '{name}' AND before + mass > 1e-5)) AS {a}_lo, "
    f"ln(max(high) FILTER (parameter = '{name}' AND before < 1 - 1e-5)) AS {a}_hi"
    for name, a in (("lambda", "lam"), ("rho", "rho")))} FROM marg1 GROUP BY ALL), {_pass(2)},
post AS (SELECT antigen, stratifier, level, parameter,
    {", ".join(f"max(CASE WHEN before < {p} AND before + mass >= {p} THEN low + ({p} - before) / mass * (high - low) END) AS {n}"
               for p, n in ((0.025, "low"), (0.5, "median"), (0.975, "high")))}
    FROM marg2 GROUP BY ALL)"""


def _curve(q: str, name: str) -> str:
    lam = f"max(CASE WHEN parameter = 'lambda' THEN {q} END)"
    rho = f"max(CASE WHEN parameter = 'rho' THEN {q} END)"
    return f"round({lam} / ({lam} + {rho}) * (1 - exp(-({lam} + {rho}) * age)), 5) AS {name}"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    # cleaning and recodes
    keep = []
    for c in _EXPORTED:
        if c in (*_IGG_CUT, "hrp2_a"):
            keep.append(f"CAST({'hrp2_1' if c == 'hrp2_a' else c} AS FLOAT) AS {c}")
        elif c in ("hhwgt", "ab_wt", "ag_wt"):
            keep.append(f"round({c}, 6) AS {c}")
        else:
            keep.append(c)
    logs = ", ".join(f"round(ln(CASE WHEN {s} > 0 THEN {s} END), 6) AS log{s}" for s in _IGG_CUT)
    o["clean_antibody"] = f"""{BASE} SELECT {", ".join(keep)}, agegrp7, {logs} FROM keyed
        WHERE gst <= 500 OR gst IS NULL"""
    flags = "hrp2_pos, paldo_pos, pldh_pos, pvldh_pos"
    o["clean_antigen"] = f"""{BASE} SELECT ptid, varunit, agegrp, {flags} FROM keyed
        WHERE hrp2_pos IS NOT NULL AND paldo_pos IS NOT NULL AND pldh_pos IS NOT NULL
          AND pvldh_pos IS NOT NULL"""
    o["recode_household"] = f"""{NET} SELECT ptid, {_YESNO.format("a1q119")} AS net_own,
        {_YESNO.format("a1q115")} AS livestock, {_YESNO.format("a1q105n")} AS aircon,
        {_YESNO.format("a1q105a")} AS electric,
        CASE a1q101a WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS water_source,
        {_YESNO.format("gender")} AS gender, {_YESNO.format("ahtype")} AS urban,
        CASE WHEN a1q108 <= 13 THEN 0 WHEN a1q108 > 20 AND a1q108 < 23 THEN 2
             WHEN a1q108 > 30 AND a1q108 < 38 THEN 1 WHEN a1q108 = 96 THEN 9 END AS roof_mat,
        CASE WHEN a1q109 <= 13 THEN 0 WHEN a1q109 > 13 AND a1q109 < 26 THEN 2
             WHEN a1q109 > 30 AND a1q109 < 38 THEN 1 WHEN a1q109 = 96 THEN 9 END AS wall_mat,
        num_nets, round(netratio, 6) AS netratio, net1_8 FROM owned"""
    o["area_key"] = f"{BASE} SELECT ptid, CAST(ahstate AS VARCHAR) AS ahstate, ahlga, lga FROM keyed"
    o["age_midpoints"] = f"""{BASE} SELECT agegrp7, CASE agegrp7 WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 4 WHEN 3 THEN 6
        WHEN 4 THEN 8 WHEN 5 THEN 10 WHEN 6 THEN 12 WHEN 7 THEN 13.5 END AS midpoint, count(*) AS n
        FROM keyed GROUP BY agegrp7"""
    o["species_flags"] = f"""{ALL_SAMPLES} SELECT ptid, pcr_species, pcr_pf, pcr_pm, pcr_po, pcr_pfmono, pcr_pm_pf,
        pcr_po_pf, selection_cri FROM lab"""
    o["floored_signals"] = f"""{BASE} SELECT ptid, {", ".join(
        f"round(CASE WHEN {s} <= 0 THEN 1 ELSE {s} END, 6) AS {s}"
        for s in ("pmmsp1", "pomsp1", "pvmsp1", "pfmsp1"))} FROM keyed"""
    o["decoded_labels"] = f"""{BASE} SELECT ptid, gender, ahzone,
        CASE gender WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS gender_label, r_name AS zone_label
        FROM keyed LEFT JOIN region ON r_regionkey = ahzone"""

    sizes = f"{BASE}, sizes AS (SELECT varunit, count(*) AS n FROM keyed GROUP BY 1)"
    o["clusters_by_size"] = f"""{sizes} SELECT varunit, n, row_number() OVER (ORDER BY n DESC, varunit DESC) AS rank
        FROM sizes"""
    o["largest_clusters"] = f"{sizes} SELECT varunit, n FROM sizes ORDER BY n DESC, varunit DESC LIMIT 10"
    o["areas_round_trip"] = f"""WITH {_SQUARES} SELECT CAST(area_id AS BIGINT) AS area_id, 'area ' || area_id AS label,
        5::BIGINT AS points, 0 AS last_part, 0 AS last_ring, gx::DOUBLE AS min_x, (gx + 1)::DOUBLE AS max_x,
        (5 * gx + 2)::DOUBLE AS sum_x, gy::DOUBLE AS min_y, (gy + 1)::DOUBLE AS max_y, (5 * gy + 2)::DOUBLE AS sum_y FROM sq"""
    o["table_round_trip"] = f"""{BASE} SELECT ahstate, count(*) AS n, CAST(sum(ptid) AS BIGINT) AS ids,
        count(age) AS n_age FROM keyed GROUP BY ahstate"""

    # closed forms of models with one factor: log odds of each level against the first one
    for name, add, var in (
        ("logistic", "0.0", "1.0 / k + 1.0 / (n - k)"),
        ("firth", "0.5", "1.0 / (n * ((k + 0.5) / (n + 1.0)) * ((n - k + 0.5) / (n + 1.0)))"),
    ):
        o[f"{name}_saturated"] = f"""{BASE}, level AS (
            SELECT wealthquintile AS q, CAST(count(*) AS DOUBLE) AS n, CAST(sum(pmpos) AS DOUBLE) AS k FROM keyed
            WHERE pmpos IS NOT NULL AND wealthquintile IS NOT NULL GROUP BY 1),
        odds AS (SELECT q, ln((k + {add}) / (n - k + {add})) AS l, {var} AS v FROM level),
        coef AS (SELECT CASE WHEN o.q = 1 THEN '(Intercept)' ELSE 'wealthquintile[' || o.q || ']' END AS term,
            CASE WHEN o.q = 1 THEN o.l ELSE o.l - f.l END AS b,
            sqrt(CASE WHEN o.q = 1 THEN o.v ELSE o.v + f.v END) AS s
            FROM odds AS o, (SELECT * FROM odds WHERE q = 1) AS f)
        SELECT term, round(b, 4) AS estimate, round(s, 4) AS se, round(b - {Z} * s, 4) AS ci_low,
            round(b + {Z} * s, 4) AS ci_high, round(exp(b), 4) AS odds_ratio, round(exp(b - {Z} * s), 4) AS or_low,
            round(exp(b + {Z} * s), 4) AS or_high, (SELECT CAST(sum(n) AS BIGINT) FROM level) AS n,
            (SELECT CAST(sum(k) AS BIGINT) FROM level) AS events FROM coef"""

    # six plain EM steps of two components from fixed starts
    signals = ["ama1", "csp", "glurp0", "hrp2", "lsa1", "pfmsp1", "pmmsp1", "pomsp1", "pvmsp1"]
    em = ["value AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS signal, ln({c}) AS x FROM keyed WHERE {c} > 0" for c in signals) + ")",
        "q0 AS (SELECT DISTINCT signal, 0.5 AS w, 4.0 AS m1, 1.0 AS s1, 6.0 AS m2, 1.0 AS s2, 0.0 AS ll FROM value)"]
    for step in range(1, 7):
        em.append(f"""part{step} AS (SELECT signal, x, w * exp(-(x - m1) * (x - m1) / (2 * s1)) / sqrt(2 * pi() * s1) AS f1,
            (1 - w) * exp(-(x - m2) * (x - m2) / (2 * s2)) / sqrt(2 * pi() * s2) AS f2 FROM value JOIN q{step - 1} USING (signal)),
        sum{step} AS (SELECT signal, count(*) AS n, sum(ln(f1 + f2)) AS ll, sum(f1 / (f1 + f2)) AS a, sum(f2 / (f1 + f2)) AS b,
            sum(x * f1 / (f1 + f2)) AS ax, sum(x * f2 / (f1 + f2)) AS bx, sum(x * x * f1 / (f1 + f2)) AS axx,
            sum(x * x * f2 / (f1 + f2)) AS bxx FROM part{step} GROUP BY signal),
        q{step} AS (SELECT signal, a / n AS w, ax / a AS m1, axx / a - (ax / a) * (ax / a) AS s1, bx / b AS m2,
            bxx / b - (bx / b) * (bx / b) AS s2, ll FROM sum{step})""")
    o["mixture_em"] = f"""{BASE}, {", ".join(em)},
        side AS (SELECT signal, w AS weight, m1 AS mean, s1 AS variance, ll FROM q6
            UNION ALL SELECT signal, 1 - w, m2, s2, ll FROM q6)
        SELECT signal, CAST(row_number() OVER (PARTITION BY signal ORDER BY mean) AS INTEGER) AS component,
            round(weight, 6) AS weight, round(mean, 6) AS mean, round(variance, 6) AS variance, round(-2 * ll, 2) AS minus2ll
        FROM side"""

    # Newton steps of a slope in age: likelihood, and bias-reduced with the hat values
    newton = ["lvl AS (SELECT CAST(age AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(pmpos) AS DOUBLE) AS k "
              "FROM keyed WHERE pmpos IS NOT NULL AND age IS NOT NULL GROUP BY 1)",
              "p0 AS (SELECT unnest(['ml', 'firth']) AS kind, 0.0 AS b0, 0.0 AS b1)"]
    for i in range(1, 26):
        newton.append(f"""mu{i} AS (SELECT kind, x, n, k, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM lvl, p{i - 1}),
        info{i} AS (SELECT kind, sum(n * mu * (1 - mu)) AS a, sum(n * mu * (1 - mu) * x) AS b, sum(n * mu * (1 - mu) * x * x) AS c
            FROM mu{i} GROUP BY kind),
        res{i} AS (SELECT kind, x, a, b, c, k - n * mu + CASE kind WHEN 'firth' THEN
            n * mu * (1 - mu) * (c - 2 * b * x + a * x * x) / (a * c - b * b) * (0.5 - mu) ELSE 0 END AS r
            FROM mu{i} JOIN info{i} USING (kind)),
        move{i} AS (SELECT kind, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum(r) AS u, sum(r * x) AS v
            FROM res{i} GROUP BY kind),
        p{i} AS (SELECT kind, b0 + (c * u - b * v) / (a * c - b * b) AS b0, b1 + (a * v - b * u) / (a * c - b * b) AS b1,
            sqrt(c / (a * c - b * b)) AS s0, sqrt(a / (a * c - b * b)) AS s1 FROM p{i - 1} JOIN move{i} USING (kind))""")
    o["logistic_slope"] = f"""{BASE}, {", ".join(newton)},
        side AS (SELECT kind, '(Intercept)' AS term, b0 AS b, s0 AS s FROM p25 UNION ALL SELECT kind, 'age', b1, s1 FROM p25)
        SELECT kind, term, round(b, 5) AS estimate, round(s, 5) AS se, round(exp(b), 5) AS odds_ratio,
            (SELECT CAST(sum(n) AS BIGINT) FROM lvl) AS n, (SELECT CAST(sum(k) AS BIGINT) FROM lvl) AS events FROM side"""
    # conditional modes of every cluster by Newton steps, then the likelihood and its gradient
    eta = "(-1.0 + 0.15 * x + 0.7 * v)"
    modes = ["pat AS (SELECT varunit AS c, CAST(age AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(pmpos) AS DOUBLE) AS k "
             "FROM keyed WHERE pmpos IS NOT NULL AND age IS NOT NULL AND varunit IS NOT NULL GROUP BY 1, 2)",
             "v0 AS (SELECT DISTINCT c, 0.0 AS v FROM pat)"]
    for i in range(1, 11):
        modes.append(f"""at{i} AS (SELECT c, v, n, k, 1 / (1 + exp(-{eta})) AS mu FROM pat JOIN v{i - 1} USING (c)),
        v{i} AS (SELECT c, any_value(v) + (0.7 * sum(k - n * mu) - any_value(v)) / (1 + 0.49 * sum(n * mu * (1 - mu))) AS v
            FROM at{i} GROUP BY c)""")
    o["glmm_laplace"] = f"""{BASE}, {", ".join(modes)},
        row AS (SELECT c, v, x, n, k, {eta} AS eta, 1 / (1 + exp(-{eta})) AS mu FROM pat JOIN v10 USING (c)),
        clu AS (SELECT c, any_value(v) AS v, sum(k * eta - n * ln(1 + exp(eta))) AS l, sum(n * mu * (1 - mu)) AS w,
            sum(k - n * mu) AS g, sum(n * mu * (1 - mu) * (1 - 2 * mu)) AS t, sum(n * mu * (1 - mu) * x) AS sx,
            sum(n * mu * (1 - mu) * (1 - 2 * mu) * x) AS tx, sum((k - n * mu) * x) AS gx FROM row GROUP BY c),
        der AS (SELECT *, 1 + 0.49 * w AS e, 0.49 / (1 + 0.49 * w) AS q FROM clu),
        tot AS (SELECT sum(l - v * v / 2 - ln(e) / 2) AS loglik, CAST(count(*) AS DOUBLE) AS clusters,
            sum(v * g - 0.7 * w / e - 0.5 * q * t * (v + 0.7 * (g - 0.7 * v * w) / e)) AS d_sd,
            sum(g - 0.5 * q * (t - t * 0.49 * w / e)) AS d_one, sum(gx - 0.5 * q * (tx - t * 0.49 * sx / e)) AS d_age FROM der)
        SELECT 'loglik' AS name, round(loglik, 4) AS value FROM tot UNION ALL SELECT 'clusters', clusters FROM tot
        UNION ALL SELECT 'sd(cluster)', round(d_sd, 4) FROM tot UNION ALL SELECT '(Intercept)', round(d_one, 4) FROM tot
        UNION ALL SELECT 'age', round(d_age, 4) FROM tot"""

    # filters
    o["inspect_signals"] = f"""{BASE} SELECT ptid, varunit, round(gst, 6) AS gst, round(pomsp1, 6) AS pomsp1
        FROM keyed WHERE pomsp1 < 0.5 OR gst > 500 OR gst IS NULL"""
    o["missing_signals"] = f"""{BASE} SELECT count(*) AS n_missing, 'missing' AS side FROM keyed WHERE gst IS NULL
        UNION ALL SELECT count(*), 'present' FROM keyed WHERE gst IS NOT NULL"""
    o["size_filter"] = f"{BASE} SELECT varunit, count(*) AS n FROM keyed GROUP BY 1 HAVING count(*) > 4"
    o["large_cluster_rows"] = f"""{BASE} SELECT ptid, varunit FROM keyed WHERE varunit IN
        (SELECT varunit FROM keyed GROUP BY 1 HAVING count(*) > 12)"""
    sets = {"pm_vs_pf": "pcr_pm = 1 OR pcr_pfmono = 1", "po_vs_pf": "pcr_po = 1 OR pcr_pfmono = 1",
            "pm_vs_negative": "pcr_pm = 1 OR pcr_species = '0'",
            "po_vs_negative": "pcr_po = 1 OR pcr_species = '0'",
            "pf_vs_negative": "pcr_pf = 1 OR pcr_species = '0'"}
    o["case_vs_reference"] = f"{ALL_SAMPLES} " + " UNION ALL ".join(
        f"SELECT '{n}' AS comparison, ptid, pcr_species, pcr_pf, pcr_pm, pcr_po FROM lab WHERE {c}"
        for n, c in sets.items())
    o["case_reference_set"] = f"""{LAB} SELECT ptid, varunit, coalesce(pcr_pm, 0) AS pcr_pm, {flags}
        FROM keyed LEFT JOIN (SELECT ptid, pcr_pm FROM lab) USING (ptid)
        WHERE pcr_pm = 1 OR (hrp2_pos = 0 AND paldo_pos = 0 AND pldh_pos = 0 AND pvldh_pos = 0)"""

    o["four_antigen_negative"] = f"""{BASE} SELECT ptid, varunit FROM keyed WHERE hrp2_pos = 0
        AND paldo_pos = 0 AND pldh_pos = 0 AND pvldh_pos = 0"""

    # joins
    covered = f"{NET}, {_LAB}"
    o["pcr_join"] = f"""{covered} SELECT ptid, cluster, pcr_species, pcr_pm, pcr_po, agegrp,
        {_YESNO.format("gender")} AS gender, {_YESNO.format("ahtype")} AS urban, wealthquintile,
        round(n_net / CAST(n_clust AS DOUBLE), 6) AS netcover_avg,
        round(net1_8 - n_net / CAST(n_clust AS DOUBLE), 6) AS netcover_ind
        FROM lab LEFT JOIN covered USING (ptid) WHERE missing_samples IS NULL"""
    o["membership"] = f"""{LAB} SELECT ahstate, CASE WHEN lab.ptid IS NULL THEN 0 ELSE 1 END AS in_lab,
        count(*) AS n FROM keyed LEFT JOIN lab ON keyed.ptid = lab.ptid GROUP BY 1, 2"""
    merged = ", ".join(
        f"max(CASE WHEN outcome = '{f}' THEN round(estimate, 6) END) AS {f}_estimate, "
        f"max(CASE WHEN outcome = '{f}' THEN round(estimate - {Z} * se, 6) END) AS {f}_ci_low, "
        f"max(CASE WHEN outcome = '{f}' THEN round(estimate + {Z} * se, 6) END) AS {f}_ci_high"
        for f in MSP1_POS)
    sero = ", ".join(
        f"count(*) FILTER ({f} = 0) AS serology_{f}_neg, count(*) FILTER ({f} = 1) AS serology_{f}_pos, "
        f"count(*) FILTER ({f} IN (0, 1)) AS serology_{f}_n" for f in ("pmpos", "popos"))
    o["state_merge"] = f"""{WEIGHTED}, {_variance(_long(MSP1_POS, "ahstate"), "ahstate, outcome")}
        SELECT * FROM (SELECT ahstate, {merged} FROM est GROUP BY 1)
        JOIN (SELECT ahstate, {sero} FROM keyed GROUP BY 1) USING (ahstate)"""

    # tables
    o["tab1"] = f"""{BASE} SELECT a1q119, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS percent,
        round(CASE WHEN a1q119 IS NOT NULL THEN count(*) END / sum(CASE WHEN a1q119 IS NOT NULL
        THEN count(*) END) OVER (), 6) AS valid_percent FROM keyed GROUP BY a1q119"""
    o["tab_freq"] = f"""{BASE} SELECT a1q120, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent,
        CAST(sum(n) OVER (ORDER BY a1q120) AS BIGINT) AS cum_n,
        round(sum(n) OVER (ORDER BY a1q120) * 100.0::DOUBLE / sum(n) OVER (), 6) AS cum_percent
        FROM (SELECT a1q120, count(*) AS n FROM keyed WHERE a1q120 IS NOT NULL GROUP BY 1)"""
    o["tab_sorted"] = f"{BASE} SELECT varunit, count(*) AS n FROM keyed GROUP BY 1"
    o["tab2"] = f"""{BASE} SELECT a.a1q119, b.wealthquintile, count(ptid) AS n
        FROM (SELECT DISTINCT a1q119 FROM keyed) a CROSS JOIN (SELECT DISTINCT wealthquintile FROM keyed) b
        LEFT JOIN keyed k ON k.a1q119 IS NOT DISTINCT FROM a.a1q119
          AND k.wealthquintile IS NOT DISTINCT FROM b.wealthquintile GROUP BY 1, 2"""
    o["tab2_wide"] = f"""{BASE} SELECT ahstate, {", ".join(
        f"count(*) FILTER (wealthquintile = {q}) AS wealthquintile_{q}" for q in range(1, 6))}
        FROM keyed GROUP BY 1"""
    o["tab3"] = f"""{ALL_SAMPLES}, joined AS (SELECT lab.*, ahstate FROM lab LEFT JOIN keyed USING (ptid))
        SELECT a.ahstate, b.selection_cri, count(j.ptid) AS n
        FROM (SELECT DISTINCT ahstate FROM joined) a
        CROSS JOIN (SELECT DISTINCT selection_cri FROM joined WHERE selection_cri IS NOT NULL) b
        LEFT JOIN joined j ON j.ahstate = a.ahstate AND j.selection_cri = b.selection_cri AND j.pcr_pm = 1
        GROUP BY 1, 2"""
    o["tab_pct"] = f"""{BASE}, c AS (SELECT agegrp, pmpos, count(*) AS n FROM keyed GROUP BY 1, 2),
        s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY agegrp) AS DOUBLE) AS row_share,
              n / CAST(sum(n) OVER (PARTITION BY pmpos) AS DOUBLE) AS col_share FROM c)
        SELECT agegrp, pmpos, n, round(row_share, 6) AS row_share, round(col_share, 6) AS col_share,
        printf('%.1f%%', round_even(row_share * 100, 1)) AS row_percent FROM s"""
    o["serology_by_age_group"] = f"""{BASE}, c AS (SELECT a.pvmsp1pos, b.agegrp7, count(ptid) AS n
        FROM (SELECT DISTINCT pvmsp1pos FROM keyed) a CROSS JOIN (SELECT DISTINCT agegrp7 FROM keyed) b
        LEFT JOIN keyed USING (pvmsp1pos, agegrp7) GROUP BY 1, 2)
        SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY agegrp7) AS DOUBLE), 6) AS share FROM c"""

    def summarise(columns: list[str], by: str | None, extra: str = "") -> str:
        head = f"{by}, " if by else ""
        tail = f"GROUP BY {by}" if by else ""
        return " UNION ALL ".join(
            f"""SELECT {head}'{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS n_null,
            CAST(avg({c}) AS FLOAT) AS mean, CAST(stddev_samp({c}) AS FLOAT) AS sd,
            CAST(min({c}) AS FLOAT) AS min,
            CAST(quantile_cont(CAST({c} AS DOUBLE), 0.25) AS FLOAT) AS q1,
            CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS FLOAT) AS median,
            CAST(quantile_cont(CAST({c} AS DOUBLE), 0.75) AS FLOAT) AS q3,
            CAST(max({c}) AS FLOAT) AS max{extra.format(c)} FROM keyed {tail}""" for c in columns)

    o["summary"] = f"{BASE} {summarise(['gst', 'pomsp1', 'ahmember', 'a1q120'], 'ahzone')}"
    o["profile"] = f"""{BASE} {summarise(["age", "ab_wt", *_IGG_CUT, "gst", "a1q119"], None,
        ", CAST(count({0}) / CAST(count(*) AS DOUBLE) AS FLOAT) AS complete_rate")}"""
    o["null_counts"] = f"""{BASE} SELECT {", ".join(
        f"count(*) - count({c}) AS {c}" for c in ("a1q119", "a1q120", "gst", "age"))} FROM keyed"""
    o["n_distinct"] = f"""{BASE} SELECT (SELECT count(*) FROM (SELECT DISTINCT varunit FROM keyed)) AS psu,
        (SELECT count(*) FROM (SELECT DISTINCT varstrat, varunit FROM keyed)) AS pairs,
        (SELECT count(*) FROM (SELECT DISTINCT a1q119, a1q120 FROM keyed)) AS answers"""
    o["hh_per_cluster"] = f"""{BASE} SELECT varunit, count(DISTINCT hh_id) AS n_households
        FROM keyed GROUP BY 1"""
    o["infection_by_state"] = f"""{ALL_SAMPLES} SELECT ahstate, {", ".join(
        f"count(*) FILTER ({f} = 0) AS {f}_neg, count(*) FILTER ({f} = 1) AS {f}_pos, count({f}) AS {f}_n"
        for f in ("pcr_pm", "pcr_po"))} FROM lab LEFT JOIN keyed USING (ptid) GROUP BY 1"""

    # groups
    o["net_coverage"] = f"""{NET} SELECT ptid, varunit, n_clust, n_net,
        round(n_net / CAST(n_clust AS DOUBLE), 6) AS netcover_avg,
        round(net1_8 - n_net / CAST(n_clust AS DOUBLE), 6) AS netcover_ind FROM covered"""
    o["weights_normalised"] = f"""{WEIGHTED} SELECT ptid, varunit, round(ab_wt, 6) AS ab_wt,
        round(wt, 6) AS s_ab_wt FROM weighted"""
    o["group_size"] = f"""{BASE} SELECT ptid, hh_id, ahmember, count(*) OVER h AS n_household,
        CAST(sum(ahmember) OVER h AS BIGINT) AS members FROM keyed WINDOW h AS (PARTITION BY hh_id)"""
    o["dupes"] = f"""{BASE} SELECT * FROM (SELECT hh_id, ptid, count(*) OVER (PARTITION BY hh_id)
        AS dupe_count FROM keyed) WHERE dupe_count > 1"""
    o["first_per_key"] = f"""{BASE} SELECT hh_id, ptid, age, varunit, pmpos FROM (SELECT *, row_number() OVER
        (PARTITION BY hh_id ORDER BY age DESC NULLS LAST, ptid) AS rn FROM keyed) WHERE rn = 1"""
    o["distinct_keys"] = f"{BASE} SELECT DISTINCT varstrat, varunit, a1q119 FROM keyed"

    # quality
    o["quality_rules"] = f"{BASE} " + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({c}, false)) AS violations FROM keyed"
        for n, c in {"age_in_range": "age BETWEEN 0 AND 14", "gender_coded": "gender IN (1, 2)",
                     "gst_present": "gst IS NOT NULL", "net_answer_known": "a1q119 IN (1, 2)"}.items())
    o["quality_keys"] = f"""{BASE} SELECT bool_and(ahstate IS NOT DISTINCT FROM varstrat) AS state_is_stratum,
        bool_and(ahzone IS NOT DISTINCT FROM varstrat) AS zone_is_stratum,
        count(DISTINCT varunit) AS n_inner, count(DISTINCT (varstrat, varunit)) AS n_pairs,
        count(DISTINCT varunit) = count(DISTINCT (varstrat, varunit)) AS nested,
        (SELECT count(*) FROM (SELECT ptid FROM keyed GROUP BY 1 HAVING count(*) > 1)) AS repeated_ptid,
        (SELECT count(*) FROM (SELECT ahstate FROM keyed GROUP BY 1 HAVING count(DISTINCT ahzone) > 1))
          AS split_states FROM keyed"""

    # survey estimates
    o["design_check"] = f"""{BASE}, psu AS (SELECT varstrat, varunit, count(*) AS n,
        count(*) - count(ab_wt) AS nn FROM keyed GROUP BY 1, 2),
        st AS (SELECT varstrat, count(*) AS p, sum(n) AS n, sum(nn) AS nn FROM psu GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_strata, CAST(sum(p) AS BIGINT) AS n_psu,
        min(p) AS min_psu_per_stratum, max(p) AS max_psu_per_stratum, count(*) FILTER (p = 1) AS n_lonely,
        (SELECT count(*) FROM (SELECT varunit FROM psu GROUP BY 1 HAVING count(*) > 1)) AS n_split_psu,
        CAST(sum(nn) AS BIGINT) AS n_null_weight FROM st"""
    o["svy_prev_by_state"] = f"""{WEIGHTED}, {_variance(_long(["pmmsp1pos"], "ahstate"), "ahstate, outcome")}
        SELECT ahstate, n, round(estimate, 6) AS estimate, round(se, 6) AS se, {_ci(6)} FROM est"""
    o["svy_total"] = f"""{WEIGHTED}, {_variance(_long(MSP1_POS, "1 AS one"), "one, outcome", "total")}
        SELECT outcome, n, round(estimate, 4) AS estimate, round(se, 4) AS se, {_ci(4)} FROM est"""
    o["svy_mean"] = f"""{WEIGHTED}, {_variance(_long(["age", "pomsp1"], "1 AS one"), "one, outcome")}
        SELECT outcome, n, round(estimate, 5) AS estimate, round(se, 5) AS se, {_ci(5)},
        round(se / estimate, 5) AS cv FROM est"""
    levels = " UNION ALL ".join(
        f"SELECT '{v}' AS level, varstrat AS h, varunit AS i, wt, CASE WHEN agegrp = {v} THEN 1.0::DOUBLE ELSE 0 END AS y "
        "FROM weighted WHERE agegrp IS NOT NULL" for v in (1, 2, 3))
    o["svy_levels"] = f"""{WEIGHTED}, {_variance(levels, "level")}
        SELECT level, n, round(estimate, 6) AS estimate, round(se, 6) AS se, {_ci(6)} FROM est"""
    o["svy_table_2way"] = f"""{WEIGHTED}, f AS (SELECT a.ahstate, b.pfmsp1pos, coalesce(sum(wt), 0) AS freq
        FROM (SELECT DISTINCT ahstate FROM keyed) a CROSS JOIN (SELECT DISTINCT pfmsp1pos FROM keyed) b
        LEFT JOIN weighted USING (ahstate, pfmsp1pos) GROUP BY 1, 2)
        SELECT ahstate, pfmsp1pos, round(freq, 5) AS freq, round(freq / sum(freq) OVER (), 5) AS prop FROM f"""
    o["svy_table_1way"] = f"""{NET}, w AS (SELECT *, ab_wt * count(*) OVER c / sum(ab_wt) OVER c AS wt FROM owned
        WINDOW c AS (PARTITION BY varunit)) SELECT net1_8, round(sum(wt), 5) AS freq,
        round(sum(wt) / sum(sum(wt)) OVER (), 5) AS prop FROM w WHERE net1_8 IS NOT NULL GROUP BY 1"""
    o["svy_rse_by_area"] = f"""{WEIGHTED}, {_variance(_long(MSP1_POS, "lga"), "lga, outcome")}
        SELECT lga, outcome, n, round(estimate, 5) AS estimate, round(se, 5) AS se,
        round(CASE WHEN estimate <> 0 THEN se / estimate END * 100, 5) AS rse FROM est"""
    for name, col in (("svy_quantiles", "age"), ("svy_signal_quantiles", "pvmsp1")):
        shown = (lambda c: c) if col == "age" else (lambda c: f"round({c}, 6)")
        under = (f"SELECT p, varstrat AS h, varunit AS i, wt, CASE WHEN {col} <= quantile THEN 1.0 ELSE 0.0 END AS y "
                 f"FROM weighted, q WHERE {col} IS NOT NULL")
        t = _t_point("df")
        o[name] = f"""{WEIGHTED}, f AS (SELECT {col} AS x, sum(wt) AS w FROM weighted WHERE {col} IS NOT NULL
            GROUP BY 1), c AS (SELECT x, sum(w) OVER (ORDER BY x) AS cw, sum(w) OVER () AS tw FROM f),
            q AS ({" UNION ALL ".join(
                f"SELECT {p}::DOUBLE AS p, min(x) AS quantile FROM c WHERE cw >= {p} * tw * (1 - 1e-12)"
                for p in (0, 0.25, 0.5, 0.75, 1))}), {_variance(under, "p")},
            free AS (SELECT (SELECT count(DISTINCT varunit) - count(DISTINCT varstrat) FROM weighted)::DOUBLE AS df),
            reach AS (SELECT p, quantile, se, greatest(p - {t} * se, 0) AS lo, least(p + {t} * se, 1) AS hi
                FROM est JOIN q USING (p), free),
            low AS (SELECT p, min(x) AS ci_low FROM reach, c WHERE cw >= lo * tw * (1 - 1e-12) GROUP BY p),
            high AS (SELECT p, min(x) AS ci_high FROM reach, c WHERE cw >= hi * tw * (1 - 1e-12) GROUP BY p)
            SELECT p, {shown("quantile")} AS quantile, {shown("ci_low")} AS ci_low, {shown("ci_high")} AS ci_high,
                round(se, 6) AS se
            FROM reach JOIN low USING (p) JOIN high USING (p)"""
    domains = " UNION ALL ".join(
        _long(MSP1_POS, f"'{d}' AS domain, CAST({d} AS VARCHAR) AS level") for d in ("ahzone", "ahstate", "lga"))
    o["svy_sweep"] = f"""{WEIGHTED}, {_variance(domains, "domain, level, outcome")}
        SELECT domain, level, outcome, n, round(estimate, 5) AS estimate, round(se, 5) AS se, {_ci(5)},
        round(CASE WHEN estimate <> 0 THEN se / estimate END * 100, 5) AS rse FROM est"""
    lone = ("lone AS (SELECT *, CASE WHEN varunit % 500 = 0 THEN 1000 + varunit ELSE varstrat END AS hh "
            "FROM weighted)")

    def lonely(stat: str) -> str:
        long = _long(["pmpos"], "gender", "lone", "hh")
        return (f"{WEIGHTED}, {lone}, {_variance(long, 'gender, outcome', stat, 'lone', 'hh')} SELECT gender, n, "
                f"round(estimate, 5) AS estimate, round(se, 5) AS se, '{stat}' AS stat FROM est")

    o["svy_lonely_psu"] = f"SELECT * FROM ({lonely('mean')}) UNION ALL SELECT * FROM ({lonely('total')})"
    o["svy_area_counts"] = f"""{WEIGHTED} SELECT lga, count(*) AS n, {", ".join(
        f"round(sum(wt * {f}), 5) AS n_{f}" for f in MSP1_POS)} FROM weighted GROUP BY 1"""

    # regression, correlation
    moments = """m AS (SELECT ahzone, regr_count(pvmsp1, pfmsp1) AS n, regr_slope(pvmsp1, pfmsp1) AS slope,
        regr_intercept(pvmsp1, pfmsp1) AS intercept, regr_r2(pvmsp1, pfmsp1) AS r2,
        regr_sxx(pvmsp1, pfmsp1) AS sxx, regr_syy(pvmsp1, pfmsp1) AS syy, regr_sxy(pvmsp1, pfmsp1) AS sxy,
        regr_avgx(pvmsp1, pfmsp1) AS mx, min(pfmsp1) AS lo, max(pfmsp1) AS hi FROM keyed GROUP BY 1),
        s AS (SELECT *, sqrt((syy - slope * sxy) / (n - 2)) AS sigma FROM m)"""
    o["ols"] = f"""{BASE}, {moments} SELECT ahzone, CAST(n AS BIGINT) AS n, round(intercept, 4) AS intercept,
        round(slope, 4) AS slope, round(sigma * sqrt(1.0 / n + mx * mx / sxx), 4) AS se_intercept,
        round(sigma / sqrt(sxx), 4) AS se_slope,
        round(intercept / (sigma * sqrt(1.0 / n + mx * mx / sxx)), 4) AS t_intercept,
        round(slope / (sigma / sqrt(sxx)), 4) AS t_slope, round(r2, 4) AS r2, round(sigma, 4) AS sigma,
        round(slope * sxy / (sigma * sigma), 4) AS f_value, CAST(n - 2 AS BIGINT) AS df FROM s"""
    o["regression_line"] = f"""{BASE}, {moments}, g AS (SELECT *, lo + range * (hi - lo) / 19.0 AS x
        FROM s, range(20)), band AS (SELECT *, intercept + slope * x AS fit,
            sigma * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx) AS se, {_t_point("(n - 2)")} AS t FROM g)
        SELECT ahzone, round(x, 4) AS x, round(fit, 4) AS fit, round(se, 4) AS se, round(fit - t * se, 4) AS ci_low,
            round(fit + t * se, 4) AS ci_high, round(r2, 4) AS r2 FROM band"""
    o["corr_test"] = f"""{BASE}, c AS (SELECT ahzone, count(*) AS n, corr(pmmsp1, pomsp1) AS r FROM keyed
        WHERE pmmsp1 IS NOT NULL AND pomsp1 IS NOT NULL GROUP BY 1), z AS (SELECT *,
        0.5 * ln((1 + r) / (1 - r)) AS z, {Z} / sqrt(n - 3) AS half FROM c)
        SELECT ahzone, n, CAST(n - 2 AS BIGINT) AS df, round(r, 4) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t,
        round((exp(2 * (z - half)) - 1) / (exp(2 * (z - half)) + 1), 4) AS ci_low,
        round((exp(2 * (z + half)) - 1) / (exp(2 * (z + half)) + 1), 4) AS ci_high FROM z"""

    # areas
    areas = f"WITH {_SQUARES}, {_EDGES}"
    degree = """deg AS (SELECT area_id, count(dst) AS links FROM sq LEFT JOIN edges ON src = area_id
        GROUP BY 1)"""
    o["queen_nb"] = f"{areas} SELECT src, dst FROM edges"
    o["nb_summary"] = f"""{areas}, {degree} SELECT count(*) AS regions, CAST(sum(links) AS BIGINT) AS links,
        round(avg(links), 6) AS mean_links, min(links) AS min_links, max(links) AS max_links,
        count(*) FILTER (links = 0) AS isolated FROM deg"""
    o["nb_histogram"] = f"{areas}, {degree} SELECT links, count(*) AS areas FROM deg GROUP BY 1"
    o["centroid"] = f"""WITH {_SQUARES} SELECT area_id, 1.0::DOUBLE AS area, gx + 0.5::DOUBLE AS cx,
        gy + 0.5::DOUBLE AS cy FROM sq"""
    o["eb_local"] = f"{_EB} SELECT area_id, outcome, {_dup(['n', 'r', 'raw', 'est'])} FROM eb"
    o["smoothed_areas"] = f"""{_EB} SELECT area_id,
        round(max(CASE WHEN outcome = 'n_pmpos' THEN est END), 6) AS eb_pmpos,
        round(max(CASE WHEN outcome = 'n_popos' THEN est END), 6) AS eb_popos, 1 AS parts, 5 AS points
        FROM eb GROUP BY 1"""

    # seroconversion
    o["age_bins_wilson"] = f"""{BASE}, b AS (SELECT gender, CAST(ceil(age / 2.0) AS INT) AS bin, count(*) AS n,
        CAST(sum(pmpos) AS BIGINT) AS k FROM person WHERE age > 0 AND age <= 14 GROUP BY 1, 2),
        p AS (SELECT *, k / CAST(n AS DOUBLE) AS p, {Z} * {Z} AS z2 FROM b)
        SELECT gender, bin, 2.0 * bin - 0.5::DOUBLE AS midpoint, n, k, round(p, 6) AS p,
        round((p + z2 / (2 * n) - {Z} * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 6) AS ci_low,
        round((p + z2 / (2 * n) + {Z} * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 6) AS ci_high
        FROM p"""
    o["serostatus_counts"] = f"""{BASE}, counts AS ({_sero_counts(_STRATA)})
        SELECT * FROM counts WHERE level IS NOT NULL"""
    sp = "0.12 / 0.2 * (1 - exp(-0.2 * age))"
    o["sero_loglik"] = f"""{BASE}, counts AS ({_sero_counts(_STRATA)})
        SELECT antigen, stratifier, level,
        round(sum(k * ln(CAST({sp} AS DOUBLE)) + (n - k) * ln(CAST(1 - {sp} AS DOUBLE))), 4) AS loglike,
        round(2 * ln(0.1::DOUBLE), 4) AS prior FROM counts GROUP BY 1, 2, 3"""
    o["sero_grid_posterior"] = f"""{_GRID} SELECT antigen, stratifier, level, parameter,
        {_dup(["low", "median", "high"], 5)} FROM post"""
    o["sero_density"] = f"""{_GRID} SELECT antigen, stratifier, level, parameter, cell,
        round((low + high) / 2, 5) AS x, round(mass / (high - low), 5) AS density,
        CASE WHEN before + mass / 2 < 0.025 THEN 'lower' WHEN before + mass / 2 > 0.975 THEN 'upper'
        ELSE 'middle' END AS region FROM marg"""
    o["sero_curve"] = f"""{_GRID} SELECT antigen, stratifier, level, CAST(age AS INT) AS age,
        {_curve("median", "fit")}, {_curve("low", "fit_low")}, {_curve("high", "fit_high")}
        FROM post, (SELECT range AS age FROM range(15)) GROUP BY antigen, stratifier, level, age"""
    o["sero_posterior"] = f"""{_FINE} SELECT antigen, stratifier, level, parameter,
        {_dup(["low", "median", "high"], 5)} FROM post"""
    o["sero_density_fine"] = f"""{_FINE} SELECT antigen, stratifier, level, parameter, cell,
        round((low + high) / 2, 6) AS x, round(mass, 6) AS mass,
        CASE WHEN before + mass / 2 < 0.025 THEN 'lower' WHEN before + mass / 2 > 0.975 THEN 'upper'
        ELSE 'middle' END AS region FROM marg2"""
    o["sero_curve_fine"] = f"""{_FINE} SELECT antigen, stratifier, level, CAST(age AS INT) AS age,
        {_curve("median", "fit")}, {_curve("low", "fit_low")}, {_curve("high", "fit_high")}
        FROM post, (SELECT range AS age FROM range(15)) GROUP BY antigen, stratifier, level, age"""
    o["signal_density"] = f"""{BASE}, f0 AS (SELECT ahzone, count(pvmsp1) AS n, min(pvmsp1) AS mn, max(pvmsp1) AS mx,
        stddev_samp(pvmsp1) AS sd, (quantile_cont(pvmsp1, 0.75) - quantile_cont(pvmsp1, 0.25)) / 1.34 AS iqr
        FROM person GROUP BY 1), f1 AS (SELECT *, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END
        * power(n, -0.2) AS bw FROM f0), f AS (SELECT ahzone, n, bw, mn - 3 * bw AS lo, mx + 3 * bw AS hi FROM f1),
        p AS (SELECT ahzone, (pvmsp1 - lo) / ((hi - lo) / 1023.0) AS pos FROM person JOIN f USING (ahzone)
              WHERE pvmsp1 IS NOT NULL),
        mass AS (SELECT ahzone, k, sum(w) AS w FROM (
            SELECT ahzone, floor(pos) AS k, 1 - (pos - floor(pos)) AS w FROM p UNION ALL
            SELECT ahzone, floor(pos) + 1, pos - floor(pos) FROM p) GROUP BY 1, 2),
        g AS (SELECT f.*, range AS point, lo + range * (hi - lo) / 511.0 AS x FROM f, range(512))
        SELECT ahzone, CAST(point AS INT) AS point, round(x, 6) AS x,
        round(sum(w * exp(-power((x - (lo + k * (hi - lo) / 1023.0)) / bw, 2) / 2)) / (n * bw * sqrt(2 * pi())), 6)
          AS density FROM g JOIN mass USING (ahzone) GROUP BY ahzone, point, x, n, bw"""

    # smoothing and plot data
    o["boxplot_stats"] = f"""{BASE}, y AS (SELECT ahzone, gender, log10(CASE WHEN pomsp1 <= 0 THEN 1
        ELSE pomsp1 END) AS y FROM keyed WHERE pomsp1 IS NOT NULL),
        q AS (SELECT ahzone, gender, count(*) AS n, quantile_cont(y, 0.25) AS q1,
              quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM y GROUP BY 1, 2)
        SELECT ahzone, gender, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(min(y) FILTER (y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
        round(max(y) FILTER (y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
        count(*) FILTER (NOT y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM y JOIN q USING (ahzone, gender) GROUP BY ahzone, gender, n, q1, median, q3"""
    o["scatter_bins"] = f"""{BASE} SELECT CAST(floor(pfmsp1 / 100.0) AS BIGINT) AS x_bin,
        CAST(floor(pvmsp1 / 20.0) AS BIGINT) AS y_bin, count(*) AS n FROM keyed
        WHERE pfmsp1 IS NOT NULL AND pvmsp1 IS NOT NULL GROUP BY 1, 2"""
    o["hist_sizes"] = f"""{BASE}, s AS (SELECT CAST(count(*) AS DOUBLE) AS x FROM keyed GROUP BY varunit),
        r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS cell FROM s),
        b AS (SELECT *, power(10::DOUBLE, floor(log10(cell))) AS base FROM r),
        u AS (SELECT *, CASE WHEN 2 * base - cell >= 1.5 * (cell - base) THEN base
              WHEN 5 * base - cell >= 2.75 * (cell - 2 * base) THEN 2 * base
              WHEN 10 * base - cell >= 1.5 * (cell - 5 * base) THEN 5 * base ELSE 10 * base END AS step FROM b),
        e AS (SELECT step, floor(lo / step) AS f, ceil(hi / step) AS t FROM u),
        g AS (SELECT (f + range) * step AS bin_low, (f + range + 1) * step AS bin_high, range AS i
              FROM e, range(1000) WHERE f + range < t)
        SELECT bin_low, bin_high, count(x) AS n FROM g LEFT JOIN s
        ON (x > bin_low OR (i = 0 AND x = bin_low)) AND x <= bin_high GROUP BY 1, 2"""
    prev = """{base}, a AS ({parts})"""
    o["age_profile"] = f"{BASE} " + " UNION ALL ".join(
        f"""SELECT {_YESNO.format("ahtype")} AS urban, {_YESNO.format("a1q105n")} AS aircon, age,
        '{f}' AS outcome, count({f}) AS n, round(avg({f}), 6) AS prevalence FROM keyed GROUP BY 1, 2, 3"""
        for f in ("pmpos", "popos"))
    parts = " UNION ALL ".join(
        f"SELECT gender, '{f}' AS outcome, CAST(age AS DOUBLE) AS x, avg({f}) AS y FROM keyed GROUP BY 1, 2, 3"
        for f in ("pmpos", "popos"))
    o["loess_age"] = prev.format(base=BASE, parts=parts) + """,
        g AS (SELECT range / 10.0::DOUBLE AS x0 FROM range(141)),
        d AS (SELECT gender, outcome, x0, x, y, abs(x - x0) AS dist,
              row_number() OVER (PARTITION BY gender, outcome, x0 ORDER BY abs(x - x0)) AS rk,
              count(*) OVER (PARTITION BY gender, outcome, x0) AS m,
              min(x) OVER (PARTITION BY gender, outcome) AS xl,
              max(x) OVER (PARTITION BY gender, outcome) AS xh FROM a, g),
        h AS (SELECT *, max(CASE WHEN rk <= floor(m * 0.5) THEN dist END)
              OVER (PARTITION BY gender, outcome, x0) AS h FROM d),
        w AS (SELECT *, x - x0 AS u, CASE WHEN dist < h THEN power(1 - power(dist / h, 3), 3) ELSE 0 END AS w
              FROM h),
        s AS (SELECT gender, outcome, x0, xl, xh, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
              sum(w * power(u, 3)) AS s3, sum(w * power(u, 4)) AS s4, sum(w * y) AS t0,
              sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM w GROUP BY 1, 2, 3, 4, 5)
        SELECT gender, outcome, round(x0, 5) AS x, round(CASE WHEN x0 BETWEEN xl AND xh THEN
          (t0 * (s2 * s4 - s3 * s3) + t1 * (s2 * s3 - s1 * s4) + t2 * (s1 * s3 - s2 * s2)) /
          (s0 * (s2 * s4 - s3 * s3) + s1 * (s2 * s3 - s1 * s4) + s2 * (s1 * s3 - s2 * s2)) END, 5) AS fit
        FROM s"""

    # models
    scored = f"""{BASE}, scored AS (SELECT ptid, age, ahmember, pmpos AS y,
        1 / (1 + exp(-(CAST(-1.4 AS DOUBLE) + 0.11::DOUBLE * age - 0.05::DOUBLE * ahmember))) AS p FROM person)"""
    ll = "CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END"
    o["gof"] = f"""{scored} SELECT count(*) AS n, round(sum(-2 * {ll}), 4) AS deviance,
        round(sum((y - p) * (y - p) / (p * (1 - p))), 4) AS pearson, count(*) - 3 AS df FROM scored"""
    o["hosmer"] = f"""{scored}, q AS (SELECT {", ".join(
        f"quantile_cont(p, {i / 10}) AS q{i}" for i in range(1, 10))} FROM scored),
        g AS (SELECT {" + ".join(f"CASE WHEN p > q{i} THEN 1 ELSE 0 END" for i in range(1, 10))} AS bin,
              count(*) AS n, sum(y) AS o1, sum(p) AS e1 FROM scored, q GROUP BY 1)
        SELECT round(sum((o1 - e1) * (o1 - e1) / e1 + (o1 - e1) * (o1 - e1) / (n - e1)), 4) AS chisq,
        count(*) AS groups, count(*) - 2 AS df FROM g"""
    binned = f"""{scored}, s AS (SELECT p, y - p AS r, row_number() OVER (ORDER BY p) AS rn,
        count(*) OVER () AS n FROM scored), k AS (SELECT CAST(floor(sqrt(max(n))) AS BIGINT) AS k FROM s),
        br AS (SELECT DISTINCT p AS b FROM s, k, range(1, 100000) t WHERE t.range < k
               AND rn = (n * t.range) // k),
        v AS (SELECT p, count(*) AS n, sum(r) AS r1, sum(r * r) AS r2 FROM s GROUP BY p),
        l AS (SELECT v.*, (SELECT count(*) FROM br WHERE b < v.p) AS bin FROM v),
        g AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(p * n) / sum(n) AS mean_p, sum(r1) / sum(n) AS mean_resid,
              2 * sqrt(greatest(sum(r2) - sum(r1) * sum(r1) / sum(n), 0) / (sum(n) - 1)) / sqrt(sum(n)) AS bound
              FROM l GROUP BY bin)"""
    o["binned_resid"] = f"""{binned} SELECT n, {_dup(["mean_p", "mean_resid", "bound"])},
        abs(mean_resid) <= bound AS inside FROM g"""
    o["binned_resid_share"] = f"""{binned} SELECT count(*) AS bins,
        round(avg(CASE WHEN abs(mean_resid) <= bound THEN 1.0::DOUBLE ELSE 0 END), 6) AS inside FROM g"""
    o["model_performance"] = f"""{scored} SELECT count(*) AS n, round(sum({ll}), 4) AS loglik,
        round(avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0), 4) AS r2_tjur,
        round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(6 - 2 * sum({ll}), 4) AS aic,
        round(3 * ln(count(*)) - 2 * sum({ll}), 4) AS bic FROM scored"""
    o["residual_trend"] = f"""{scored}, q AS (SELECT {", ".join(
        f"quantile_cont(age::DOUBLE, {i / 10}) AS q{i}" for i in range(1, 10))} FROM scored),
        g AS (SELECT {" + ".join(f"CASE WHEN age > q{i} THEN 1 ELSE 0 END" for i in range(1, 10))} AS bin,
              age, (y - p) / sqrt(p * (1 - p)) AS r FROM scored, q)
        SELECT count(*) AS n, round(avg(age), 6) AS mean_x, round(avg(r), 6) AS mean_pearson FROM g GROUP BY bin"""
    o["separation_levels"] = f"{BASE} " + " UNION ALL ".join(
        f"""SELECT '{t}' AS term, CAST({c} AS VARCHAR) AS level, count(*) AS n,
        CAST(sum(popos) AS BIGINT) AS events, sum(popos) = 0 OR sum(popos) = count(*) AS separated
        FROM keyed WHERE {c} IS NOT NULL GROUP BY {c}"""
        for t, c in (("agegrp", "agegrp"), ("wealthquintile", "wealthquintile"),
                     ("gender", f"({_YESNO.format('gender')})"), ("age", "age")))
    o["separation_ranges"] = f"""{NET}, c AS (SELECT popos AS y, n_net / CAST(n_clust AS DOUBLE) AS netcover_avg,
        net1_8 - n_net / CAST(n_clust AS DOUBLE) AS netcover_ind, CAST(age AS DOUBLE) AS age FROM covered),
        r AS ({" UNION ALL ".join(f"""SELECT '{t}' AS term, min({t}) FILTER (y = 0) AS lo0,
        max({t}) FILTER (y = 0) AS hi0, min({t}) FILTER (y = 1) AS lo1, max({t}) FILTER (y = 1) AS hi1 FROM c"""
        for t in ("netcover_avg", "netcover_ind", "age"))})
        SELECT term, {_dup(["lo0", "hi0", "lo1", "hi1"])}, hi0 <= lo1 OR hi1 <= lo0 AS separated FROM r"""
    return o
