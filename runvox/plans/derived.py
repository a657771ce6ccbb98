"""Canonical tables derived from the driver's tables.

The given tables hold no scans, so each base view below turns one of them, whole, into a table of the data model:
suppliers become case headers, line items voxels, documents cases of a split, pages files of an inventory. The text is
plain SQL that Spark and the oracle both run, so the two sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runvox.operators.score import surface_triangles

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
ORGANS = ["adrenal_left", "adrenal_right", "kidney_left", "kidney_right", "liver", "spleen", "aorta"]
LETTERS = "etaoinshrdlucmpg"
PREFIXES = ["small", "large", "red", "blue", "hot", "cold", "old"]


def source_of(k: str) -> str:
    return f"CASE {k} % 4 WHEN 0 THEN 'ts' WHEN 1 THEN 'amos' WHEN 2 THEN 'btcv' ELSE 'flare' END"


def case_of(k: str) -> str:
    return f"CASE WHEN {k} % 3 = 0 THEN concat({source_of(k)}, '_', {k}) ELSE concat('s', {k}) END"


def _pick(values: list[str], k: str, start: int = 0) -> str:
    whens = " ".join(f"WHEN {i + start} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {k} {whens} ELSE '{values[-1]}' END"


_KEY = f"{source_of('l_suppkey')} AS source, {case_of('l_suppkey')} AS case_id"
_SHIFT = "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END"


def _voxel(number: str = "l_linenumber", day: str = "dayofyear(l_shipdate)") -> str:
    """A line item as a voxel of organ ``number`` (right-hand organs lie eight columns further)."""
    m = f"CASE WHEN {number} = 2 THEN 4 ELSE 8 END"
    return (f"{_KEY}, {_pick(ORGANS, f'({number})', 1)} AS organ, "
            f"CAST(l_partkey % ({m}) + {_SHIFT} + CASE WHEN {number} IN (2, 4, 5) THEN 8 ELSE 0 END AS INT) AS x, "
            f"CAST(CAST(l_quantity AS INT) % ({m}) + {_SHIFT} AS INT) AS y, "
            f"CAST(({day}) % ({m}) + {_SHIFT} AS INT) AS z")


#: Every line item is a voxel of the truth; some cases have no aorta or no glands, whose items belong to other organs.
_TRUTH_ORGAN = ("CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN 5 WHEN l_linenumber IN (1, 2) AND l_suppkey % 11 = 3 "
                "THEN l_linenumber + 2 ELSE l_linenumber END")
#: And every one is a voxel of the prediction, which misses some right kidneys and puts items that are not shipped elsewhere.
_PRED_ORGAN = "CASE WHEN l_linenumber = 4 AND l_suppkey % 6 = 0 THEN 3 ELSE l_linenumber END"
_PRED_DAY = "dayofyear(l_shipdate) + CASE WHEN l_linestatus <> 'F' AND l_orderkey % 2 = 0 THEN 1 ELSE 0 END"

BASE = {
    "v_header": f"""
        SELECT {source_of('s_suppkey')} AS source, {case_of('s_suppkey')} AS case_id, s_suppkey AS k,
               CASE WHEN s_suppkey % 3 = 0 THEN 16 ELSE 18 END AS sx, CASE WHEN s_suppkey % 3 = 0 THEN 8 ELSE 10 END AS sy,
               CASE WHEN s_suppkey % 3 = 0 THEN 8 ELSE 10 END AS sz, 1 + (s_suppkey % 11) * 45e-2 AS t,
               CASE WHEN s_suppkey % 7 = 0 THEN -1e0 ELSE 1e0 END AS xs, 3e-2 AS voxel_ml
        FROM supplier""",
    "v_truth": f"SELECT DISTINCT {_voxel(f'({_TRUTH_ORGAN})')} FROM lineitem",
    "v_pred": f"SELECT DISTINCT {_voxel(f'({_PRED_ORGAN})', _PRED_DAY)} FROM lineitem",
    "v_teacher": f"""
        SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'first' WHEN 'N' THEN 'second' ELSE 'third' END AS teacher,
               {_voxel()} FROM lineitem""",
    "v_labelled": f"""
        SELECT {_KEY}, CAST(l_partkey % 15 AS INT) AS label, CAST(1 AS BIGINT) AS voxels FROM lineitem""",
    "v_ct": f"""
        SELECT {_KEY}, CAST(l_partkey % 8 AS INT) AS x, CAST(CAST(l_quantity AS INT) % 8 AS INT) AS y,
               CAST(dayofyear(l_shipdate) % 8 AS INT) AS z,
               CAST(CAST(floor(max(l_extendedprice)) AS BIGINT) % 2200 - 1100 AS INT) AS hu
        FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "v_case": """
        SELECT lang AS source, concat('d', doc_id) AS case_id, concat(lang, '_d', doc_id) AS name, doc_id,
               1 + (n_chars % 9) / 2e0 AS slice_thickness_mm,
               CAST(CASE WHEN doc_id % 6 = 0 THEN 0 ELSE n_chars END AS DOUBLE) AS volume
        FROM documents""",
    "v_build": """
        SELECT concat(lang, '_d', doc_id) AS name, lang AS source,
               CASE WHEN doc_id % 7 = 0 THEN 'test' WHEN doc_id % 29 = 0 THEN 'failed' ELSE 'train' END AS role
        FROM documents""",
    "v_split": " UNION ALL ".join(f"""
        SELECT {i} AS fold, CASE WHEN doc_id % 5 = {i} THEN 'val' ELSE 'train' END AS part,
               concat(lang, '_d', doc_id) AS name
        FROM documents WHERE (doc_id % 7 <> 0 AND doc_id % 29 <> 0){' OR doc_id % 49 = 0' if i == 1 else ''}"""
                            for i in range(5)),
    "v_path": f"""
        SELECT p_partkey, concat('/data/', {_pick(['amos/train/labelsTr', 'amos/valid/labelsVa',
               'btcv/RawData/Training/label', 'flare/labels', 'flare/images', 'other/labels'], 'p_partkey % 6')}, '/c',
               p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '.txt' ELSE '.nii.gz' END) AS path
        FROM part""",
    "v_label_path": f"""
        SELECT {_pick(['amos', 'amos', 'btcv', 'flare', 'raos1'], 'p_partkey % 5')} AS source,
               concat({_pick(['train/labelsTr/amos_', 'valid/labelsVa/amos_', 'RawData/Training/label/label', 'labels/F_',
               '/a(Set1)/labelsTs/r.'], 'p_partkey % 5')}, p_partkey, '.nii.gz') AS label_path
        FROM part""",
    "v_image_path": f"""
        SELECT concat({_pick(['train/imagesTr/amos_', 'valid/imagesVa/amos_', 'RawData/Training/img/img', 'images/F_',
               '/a(Set1)/imagesTs/r.'], 'p_partkey % 5')}, p_partkey,
               CASE WHEN p_partkey % 5 = 3 OR p_partkey % 10 = 4 THEN '_0000.nii.gz' ELSE '.nii.gz' END) AS image_path
        FROM part WHERE p_partkey % 11 <> 0""",
    "v_scan": f"""
        SELECT CAST(doc_id AS BIGINT) AS ordinal, concat('d', doc_id) AS id, lang AS dataset, md5(text) AS md5,
               CAST(length(text) % 3 AS INT) AS shape_x,
               {', '.join(f"length(text) - length(replace(text, '{c}', '')) AS n_{c}" for c in LETTERS)},
               CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS is_gold
        FROM documents""",
    "v_file": """
        SELECT concat('p', page_id % 3) AS prefix, page_id, url AS name, html AS content FROM pages""",
    "v_overlap": """
        SELECT concat('shard', o_orderkey % 9) AS shard, CASE o_orderkey % 3 WHEN 0 THEN 'AMOS' WHEN 1 THEN 'BTCV' ELSE 'FLARE' END
               AS gold_dataset, CASE o_orderkey % 3 WHEN 0 THEN concat('amos_', o_custkey, '.nii.gz')
               WHEN 1 THEN concat('img', o_custkey, '.nii.gz') ELSE concat('F_', o_custkey, '_0000.nii.gz') END AS gold_scan,
               concat('B', o_orderkey) AS atlas_bdmap_id,
               CASE o_orderstatus WHEN 'O' THEN 'exact' WHEN 'F' THEN 'shape+corr' ELSE 'corr-only' END AS match_type,
               95e-2 + (o_orderkey % 600) / 1e4 AS corr, o_orderkey
        FROM orders""",
    "v_entry": """
        SELECT event_type AS source, concat('e', event_id) AS name, md5(concat(event_type, event_id)) AS sha256,
               event_id, CASE WHEN event_id % 97 = 0 THEN 'hash' ELSE 'ok' END AS status
        FROM events""",
    "v_grown": """
        SELECT concat('p', p_partkey) AS id, p_partkey, CAST(10 + p_size AS INT) AS nx,
               CAST(10 + p_partkey % 13 AS INT) AS ny, CAST(10 + p_partkey % 3 AS INT) AS nz FROM part""",
    "v_geometry": """
        SELECT concat('p', p_partkey) AS id, p_partkey, CAST(p_size AS INT) AS a, CAST(60 + p_partkey % 4 AS INT) AS b,
               5e-1 + (p_size % 3) * 25e-2 AS u, 1 + (p_partkey % 2) * 5e-1 AS w FROM part""",
}


def tables_of(name: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", BASE[name])]


def header_arrays(header: DataFrame) -> DataFrame:
    """Shape, zooms and affine as arrays, the form the operators take."""
    zx, zy = F.lit(0.8), F.lit(0.9)
    row = lambda *v: F.array(*[F.lit(x) if isinstance(x, float) else x for x in v])
    return header.select(
        "source", "case_id", "k", F.array("sx", "sy", "sz").alias("shape"), F.array(zx, zy, "t").alias("zooms"),
        F.array(row(F.col("xs") * zx, 0.0, 0.0, -10.0), row(0.0, zy, 0.0, -20.0), row(0.0, 0.0, F.col("t"), 5.0),
                row(0.0, 0.0, 0.0, 1.0)).alias("affine"), "voxel_ml")


# SQL that only the oracle uses: independent formulations of what the operators compute.
_PAIRS = [("adrenal_left", "adrenal_right"), ("kidney_left", "kidney_right"), ("spleen", "liver")]
_ORGAN_VALUES = ", ".join(f"({i + 1}, '{o}')" for i, o in enumerate(ORGANS))


def component_sql(voxels: str, keys: str, tag: str) -> dict[str, str]:
    """Connected components by label propagation over neighbouring voxels."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return {
        f"{tag}_n": f"SELECT *, row_number() OVER (ORDER BY {keys}, x, y, z) AS id FROM {voxels}",
        f"{tag}_e": f"""SELECT a.id AS a, b.id AS b FROM {tag}_n a JOIN {tag}_n b ON {same} AND abs(a.x - b.x) <= 1
            AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.id <> b.id""",
        f"{tag}_cc(id, root) USING KEY (id)": f"""SELECT id, id FROM {tag}_n UNION
            SELECT e.a, min(n.root) FROM {tag}_cc n JOIN {tag}_e e ON e.b = n.id JOIN recurring.{tag}_cc cur
            ON cur.id = e.a WHERE n.root < cur.root GROUP BY e.a""",
        tag: f"SELECT n.*, c.root FROM {tag}_n n JOIN {tag}_cc c USING (id)",
    }


ORACLE = {
    "o_organ": f"SELECT * FROM (VALUES {_ORGAN_VALUES}) AS t(organ_id, organ)",
    **component_sql("v_truth", "source, case_id, organ", "o_comp"),
    "o_size": """SELECT source, case_id, organ, root, count(*) AS voxels, min(x * 1000000 + y * 1000 + z) AS first
        FROM o_comp GROUP BY ALL""",
    "o_touch": """SELECT v.source, v.case_id, organ, bool_or(x = 0 OR y = 0 OR z = 0 OR x = sx - 1 OR y = sy - 1
        OR z = sz - 1) AS touches_edge, count(*) AS voxels, avg(x) AS mx
        FROM v_truth v JOIN v_header h USING (source, case_id) GROUP BY ALL""",
    "o_list": """SELECT source, case_id, organ, list(voxels ORDER BY voxels DESC) AS l FROM o_size GROUP BY ALL""",
    "o_dec": """SELECT h.source, h.case_id, g.organ, coalesce(len(l), 0) AS components,
        coalesce(l[1] * voxel_ml, 0) AS largest_ml, coalesce(l[2] * voxel_ml, 0) AS second_ml,
        coalesce(touches_edge, false) AS touches_edge,
        CASE WHEN l IS NULL THEN 'absent' WHEN l[2] * voxel_ml >= 3e-1 THEN 'exclude_fragmented'
             WHEN l[1] * voxel_ml <= 1 THEN 'exclude_small' WHEN touches_edge THEN 'exclude_truncated'
             WHEN len(l) > 1 THEN 'keep_despeckled' ELSE 'keep' END AS decision
        FROM v_header h CROSS JOIN (SELECT organ, organ_id FROM o_organ WHERE organ_id <= 2) g
        LEFT JOIN o_list d ON d.source = h.source AND d.case_id = h.case_id AND d.organ = g.organ
        LEFT JOIN o_touch t ON t.source = h.source AND t.case_id = h.case_id AND t.organ = g.organ""",
    "o_x": "SELECT h.source, h.case_id, organ, xs * 8e-1 * mx - 10 AS wx FROM o_touch t JOIN v_header h USING (source, case_id)",
    "o_wide": "SELECT source, case_id, " + ", ".join(
        f"max(CASE WHEN organ = '{o}' THEN wx END) AS {o}" for o in ORGANS) + " FROM o_x GROUP BY ALL",
    "o_sides": "SELECT h.source, h.case_id, CASE WHEN s = '' OR s IS NULL THEN 'ok' ELSE s END AS sides FROM v_header h LEFT JOIN ("
               "SELECT source, case_id, concat_ws('; ', " + ", ".join(
                   f"CASE WHEN {a} >= {b} THEN '{a} is not left of {b}' END" for a, b in _PAIRS)
               + ") AS s FROM o_wide) USING (source, case_id)",
    "o_cohort": """SELECT h.source, h.case_id, round(t, 3) AS slice_thickness_mm, l.decision AS adrenal_left,
        r.decision AS adrenal_right, round(l.largest_ml, 4) AS adrenal_left_largest_ml,
        round(r.largest_ml, 4) AS adrenal_right_largest_ml, sides,
        CASE WHEN round(t, 3) > 5 OR sides <> 'ok' OR l.decision LIKE 'exclude%' OR r.decision LIKE 'exclude%' THEN 'excluded'
             WHEN l.decision = 'absent' AND r.decision = 'absent' THEN 'kept_no_adrenal' ELSE 'kept_with_adrenal' END AS scan
        FROM v_header h JOIN o_sides USING (source, case_id)
        JOIN o_dec l ON l.source = h.source AND l.case_id = h.case_id AND l.organ = 'adrenal_left'
        JOIN o_dec r ON r.source = h.source AND r.case_id = h.case_id AND r.organ = 'adrenal_right'""",
    "o_count": """SELECT h.source, h.case_id, g.organ, voxel_ml, coalesce(t.n, 0) AS in_truth,
        coalesce(p.n, 0) AS in_prediction, coalesce(b.n, 0) AS intersection
        FROM v_header h CROSS JOIN o_organ g
        LEFT JOIN (SELECT source, case_id, organ, count(*) AS n FROM v_truth GROUP BY ALL) t
             ON t.source = h.source AND t.case_id = h.case_id AND t.organ = g.organ
        LEFT JOIN (SELECT source, case_id, organ, count(*) AS n FROM v_pred GROUP BY ALL) p
             ON p.source = h.source AND p.case_id = h.case_id AND p.organ = g.organ
        LEFT JOIN (SELECT source, case_id, organ, count(*) AS n FROM (SELECT * FROM v_truth INTERSECT SELECT * FROM v_pred)
                   GROUP BY ALL) b ON b.source = h.source AND b.case_id = h.case_id AND b.organ = g.organ""",
    "o_metric": """SELECT source, case_id, organ, in_truth * voxel_ml AS reference_ml, in_prediction * voxel_ml AS predicted_ml,
        (in_prediction - in_truth) * voxel_ml AS volume_error_ml, abs((in_prediction - in_truth) * voxel_ml) AS absolute_volume_error_ml,
        CASE WHEN in_truth > 0 THEN 1e2 * (in_prediction - in_truth) / in_truth END AS volume_error_pct,
        CASE WHEN in_truth > 0 THEN abs(1e2 * (in_prediction - in_truth) / in_truth) END AS absolute_volume_error_pct,
        CASE WHEN in_truth + in_prediction > 0 THEN 2e0 * intersection / (in_truth + in_prediction) END AS dice,
        in_truth > 0 AND in_prediction = 0 AS miss FROM o_count""",
    "o_window": "SELECT source, case_id, x, y, z FROM v_ct WHERE hu > -100 AND hu < 100",
    **component_sql("o_window", "source, case_id", "o_body"),
    "o_box": """SELECT source, case_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1
        FROM o_body JOIN (SELECT source, case_id, first(root ORDER BY n DESC, root) AS root FROM (
          SELECT source, case_id, root, count(*) AS n FROM o_body GROUP BY ALL) GROUP BY ALL) USING (source, case_id, root)
        GROUP BY ALL""",
    "o_std": """SELECT b.source, b.case_id, x1 - x0 + 1 AS nx, y1 - y0 + 1 AS ny, z1 - z0 + 1 AS nz,
        CASE WHEN xs < 0 THEN x1 - gx ELSE gx - x0 END AS x, gy - y0 AS y, gz - z0 AS z,
        least(greatest(coalesce(hu, -1000), -1000), 1000) AS hu
        FROM o_box b JOIN v_header h USING (source, case_id) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS gx)
        CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS gy) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INT) AS gz)
        LEFT JOIN v_ct c ON c.source = b.source AND c.case_id = b.case_id AND c.x = gx AND c.y = gy AND c.z = gz
        WHERE gx BETWEEN x0 AND x1 AND gy BETWEEN y0 AND y1 AND gz BETWEEN z0 AND z1""",
    "o_digest": """SELECT source, case_id, nx || 'x' || ny || 'x' || nz AS shape,
        md5(nx || 'x' || ny || 'x' || nz || 'x' || md5(string_agg(h, ',' ORDER BY x))) AS md5 FROM (
          SELECT source, case_id, nx, ny, nz, x, md5(string_agg(h, ',' ORDER BY y)) AS h FROM (
            SELECT source, case_id, nx, ny, nz, x, y, md5(string_agg(CAST(hu AS VARCHAR), ',' ORDER BY z)) AS h
            FROM o_std GROUP BY ALL) GROUP BY ALL) GROUP BY source, case_id, nx, ny, nz""",
    "o_sample": """SELECT s.source, s.case_id, i, j, k, sum(least(greatest(hu, -200), 300) * (1 - abs(i * (nx - 1) / 7e0 - x))
          * (1 - abs(j * (ny - 1) / 7e0 - y)) * (1 - abs(k * (nz - 1) / 7e0 - z))) AS v
        FROM o_std s JOIN (SELECT unnest(range(8)) AS i) ON abs(i * (nx - 1) / 7e0 - x) < 1
        JOIN (SELECT unnest(range(8)) AS j) ON abs(j * (ny - 1) / 7e0 - y) < 1
        JOIN (SELECT unnest(range(8)) AS k) ON abs(k * (nz - 1) / 7e0 - z) < 1 GROUP BY ALL""",
    "o_descriptor": """SELECT source, case_id, round(max(v) FILTER (WHERE i + j + k = 0), 4) AS v_first,
        round(max(v) FILTER (WHERE i + j + k = 21), 4) AS v_last, round(sum(v * (i * 64 + j * 8 + k)) / 1e3, 3) AS v_moment FROM (
          SELECT source, case_id, i, j, k, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM o_sample
          WINDOW w AS (PARTITION BY source, case_id)) GROUP BY ALL""",
    "o_triangle": "SELECT code, CAST(nx AS DOUBLE) AS nx, CAST(ny AS DOUBLE) AS ny, CAST(nz AS DOUBLE) AS nz FROM (VALUES "
                  + ", ".join(map(str, surface_triangles())) + ") AS t(code, nx, ny, nz)",
    "o_area": """SELECT source, case_id, code, t, sum(sqrt((nx * 9e-1 * t) * (nx * 9e-1 * t) + (ny * 8e-1 * t) * (ny * 8e-1 * t)
        + (nz * 8e-1 * 9e-1) * (nz * 8e-1 * 9e-1))) AS area FROM v_header CROSS JOIN o_triangle GROUP BY ALL""",
    **{f"o_{side}cell": f"""SELECT c.*, area, t FROM (
        SELECT source, case_id, organ, x + 1 - dx AS x, y + 1 - dy AS y, z + 1 - dz AS z,
               CAST(sum(1 << (4 * dx + 2 * dy + dz)) AS INT) AS code
        FROM {view} CROSS JOIN (SELECT CAST(unnest(range(2)) AS INT) AS dx) CROSS JOIN (SELECT CAST(unnest(range(2)) AS INT) AS dy)
        CROSS JOIN (SELECT CAST(unnest(range(2)) AS INT) AS dz) GROUP BY ALL HAVING sum(1 << (4 * dx + 2 * dy + dz)) < 255) c
        JOIN o_area USING (source, case_id, code)""" for side, view in (("t", "v_truth"), ("p", "v_pred"))},
    "o_near": " UNION ALL ".join(f"""
        SELECT '{a}' AS side, m.source, m.case_id, m.organ, m.x, m.y, m.z, m.area,
               min(sqrt(((m.x - n.x) * 8e-1) * ((m.x - n.x) * 8e-1) + ((m.y - n.y) * 9e-1) * ((m.y - n.y) * 9e-1)
                        + ((m.z - n.z) * m.t) * ((m.z - n.z) * m.t))) AS mm
        FROM o_{a}cell m LEFT JOIN o_{b}cell n ON n.source = m.source AND n.case_id = m.case_id AND n.organ = m.organ
          AND abs(m.x - n.x) <= 1 AND abs(m.y - n.y) <= 1 AND abs(m.z - n.z) <= 1 GROUP BY ALL"""
                                 for a, b in (("t", "p"), ("p", "t"))),
    "o_vector": "SELECT *, [" + ", ".join(f"CAST(n_{c} AS DOUBLE)" for c in LETTERS) + "] AS raw FROM v_scan",
    "o_centred": "SELECT *, list_transform(raw, lambda x: x - list_avg(raw)) AS c FROM o_vector",
    "o_unit": """SELECT *, CASE WHEN list_sum(list_transform(c, lambda x: x * x)) > 0
        THEN list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)) / len(c))) ELSE c END AS v
        FROM o_centred""",
}


def oracle(body: str) -> str:
    """``body`` with the views it needs, in dependency order, in front."""
    known = {re.match(r"\w+", n).group(): (n, text) for n, text in {**BASE, **ORACLE}.items()}
    order: list[str] = []

    def need(text: str, path: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"\b[vo]_\w+\b", text)):
            if word in known and word not in path and word not in order:
                need(known[word][1], (*path, word))
                order.append(word)

    need(body, ())
    ctes = []
    for word in order:
        head, text = known[word]
        ctes.append(f"{head} AS ({text})" if "USING KEY" in head else f"{head} AS MATERIALIZED ({text})")
    return f"WITH RECURSIVE {', '.join(ctes)} {body}" if ctes else body
