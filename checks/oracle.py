"""Check SQL for DuckDB: the expected result of each query, written a second time.

It is deliberately written in another way than the Spark code: the report is built
row by row and summed with a window, and a rebuild tests every slot against every
component.
"""

from __future__ import annotations

# The six warehouse tables, derived from the test tables.
SOURCES = """
kit_keys AS (SELECT DISTINCT CAST(floor(p_partkey / 20) AS BIGINT) AS k FROM part),
kit_copies AS (
  SELECT k, CAST(n_nationkey AS BIGINT) AS s FROM kit_keys, nation WHERE n_nationkey < 8
),
bin AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id,
         CASE WHEN n_nationkey < 10 THEN 'G' WHEN n_nationkey < 20 THEN 'R' ELSE 'S' END
           || CAST(n_regionkey AS VARCHAR) AS zone,
         lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS position,
         'A' || CAST(n_regionkey AS VARCHAR) AS shelf
  FROM nation
),
labelled_bin AS (SELECT *, zone || '-' || position || '-' || shelf AS label FROM bin),
product AS (
  SELECT p_partkey AS id, 'C-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS number,
         lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS edi, p_name AS description
  FROM part
  UNION ALL
  SELECT 1000000000 + k,
         CASE WHEN k % 10 = 9 THEN 'ZPB-' ELSE 'K-' END || lpad(CAST(k AS VARCHAR), 6, '0'),
         'E' || lpad(CAST(k AS VARCHAR), 6, '0'), 'kit ' || CAST(k AS VARCHAR)
  FROM kit_keys
),
bom AS (
  SELECT 1000000000 + CAST(floor(p_partkey / 20) AS BIGINT) AS kit_id,
         p_partkey AS part_id, CAST(1 + p_size % 3 AS BIGINT) AS quantity
  FROM part
),
serial AS (SELECT k * 100 + s AS id, 100 + s AS number FROM kit_copies),
stock AS (
  SELECT k * 100 + s AS id, 1000000000 + k AS product_id, k * 100 + s AS serial_id,
         CASE WHEN (k + s) % 3 = 0 THEN 3 ELSE 4 END AS kind,
         CASE WHEN k % 17 = 5 THEN 2 ELSE 3 END AS inventory,
         1 AS place_type, CASE WHEN k % 4 = 0 AND s = 7 THEN 371 ELSE 370 END AS place,
         1 AS holder_type,
         CASE WHEN k % 3 = 0 AND s >= 4 THEN (k + 1) % 10 ELSE k % 10 END AS holder,
         CAST(1 AS BIGINT) AS on_hand, CAST(1 AS BIGINT) AS available
  FROM kit_copies
  UNION ALL
  SELECT 1000000000000 + l_partkey * 8 + l_suppkey % 8, l_partkey, NULL, 2, 3, 1, 370, 2,
         CAST(floor(l_partkey / 20) AS BIGINT) * 100 + l_suppkey % 8,
         CAST(sum(CAST(l_quantity AS BIGINT) % 3) AS BIGINT),
         CAST(sum(CAST(l_quantity AS BIGINT) % 3) AS BIGINT)
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey, l_suppkey % 8
  UNION ALL
  SELECT 2000000000000 + l_partkey * 2 + l_linenumber % 2, l_partkey, NULL, 1, 3, 1, 370, 1,
         10 + (l_partkey + l_linenumber % 2) % 10,
         CAST(sum(CAST(l_quantity AS BIGINT) % 5) AS BIGINT),
         CAST(sum(CAST(l_quantity AS BIGINT) % 5) AS BIGINT)
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey, l_linenumber % 2
),
snapshot AS (
  SELECT lpad(CAST(l_partkey AS VARCHAR), 11, '0') AS edi,
         DATE '2001-01-01' + CAST(l_linenumber AS INTEGER) AS day,
         CASE WHEN l_linestatus = 'O' THEN 'E01' ELSE 'E02' END AS warehouse,
         CAST(l_quantity AS BIGINT) AS on_hand, CAST(l_quantity AS BIGINT) % 7 AS on_reserve,
         CAST(l_quantity AS BIGINT) % 3 AS unavailable
  FROM lineitem WHERE l_returnflag = 'A'
)
"""

# Intermediate relations, in order; a statement is prefixed with all of them and
# the ones it does not use cost nothing.
RELATIONS = """
here AS (SELECT * FROM stock WHERE place_type = 1 AND place = 370),
central_kit AS (
  SELECT DISTINCT product_id AS kit_id FROM stock WHERE kind IN (3, 4) AND inventory = 3
),
kit_row AS (
  SELECT DISTINCT c.kit_id, b.part_id, b.quantity
  FROM central_kit c LEFT JOIN bom b USING (kit_id)
),
named_row AS (
  SELECT k.number AS kit, k.edi AS kit_edi, k.description AS kit_description,
         p.number AS part, p.edi AS part_edi, p.description AS part_description, r.quantity
  FROM kit_row r JOIN product k ON k.id = r.kit_id LEFT JOIN product p ON p.id = r.part_id
  WHERE k.number NOT LIKE 'ZPB%'
),
loose AS (
  SELECT p.number AS part, p.edi AS part_edi, b.label, CAST(sum(h.available) AS BIGINT) AS pieces
  FROM here h JOIN labelled_bin b ON b.id = h.holder LEFT JOIN product p ON p.id = h.product_id
  WHERE h.kind = 1 AND h.inventory = 3 AND h.holder_type = 1 AND h.available > 0
    AND starts_with(b.zone, 'R')
  GROUP BY ALL
),
kit_unit AS (
  SELECT h.id, h.kind, h.inventory, h.on_hand, h.serial_id, b.label,
         p.number AS kit, p.edi AS kit_edi, p.description AS kit_description
  FROM here h JOIN labelled_bin b ON b.id = h.holder AND h.holder_type = 1
  LEFT JOIN product p ON p.id = h.product_id
  WHERE h.kind IN (3, 4) AND starts_with(b.zone, 'G')
),
kind_sum AS (
  SELECT kit, kit_edi, kit_description, kind, CAST(sum(on_hand) AS BIGINT) AS units
  FROM kit_unit WHERE inventory = 3 GROUP BY ALL
),
share AS (
  SELECT kit, kit_edi, kit_description,
         CAST(sum(units) FILTER (kind = 3) AS BIGINT) AS good,
         CAST(sum(units) FILTER (kind = 4) AS BIGINT) AS bad,
         CASE WHEN good IS NULL THEN 1.0 WHEN bad IS NULL THEN 0.0
              ELSE CAST(bad AS DOUBLE) / CAST(good + bad AS DOUBLE) END AS invalid_share
  FROM kind_sum GROUP BY kit, kit_edi, kit_description
),
holding AS (
  SELECT k.number AS kit, k.edi AS kit_edi, k.description AS kit_description,
         s.number AS serial_number, b.label, p.number AS part, p.edi AS part_edi,
         p.description AS part_description, CAST(sum(h.available) AS BIGINT) AS pieces
  FROM here h JOIN stock u ON u.id = h.holder JOIN product k ON k.id = u.product_id
  LEFT JOIN serial s ON s.id = u.serial_id
  LEFT JOIN labelled_bin b ON b.id = u.holder AND u.holder_type = 1
  LEFT JOIN product p ON p.id = h.product_id
  WHERE h.kind = 2 AND h.holder_type = 2 AND k.number IS NOT NULL
  GROUP BY ALL
),
elsewhere AS (
  SELECT edi, CAST(sum(on_hand - on_reserve - unavailable) AS BIGINT) AS pieces
  FROM snapshot WHERE day = DATE '2001-01-04' AND warehouse = 'E01' GROUP BY edi
),
kit_serial AS (
  SELECT DISTINCT u.kit, u.kit_edi, s.number AS serial_number
  FROM kit_unit u LEFT JOIN serial s ON s.id = u.serial_id WHERE u.inventory = 3
),
kit_place AS (
  SELECT DISTINCT kit, kit_edi, kit_description, label FROM kit_unit WHERE kit IS NOT NULL
),
grid AS (
  SELECT n.*, s.serial_number FROM named_row n LEFT JOIN kit_serial s ON s.kit = n.kit
),
report AS (
  SELECT g.kit AS kit_product_number, g.kit_edi, g.kit_description, g.serial_number,
         kp.label AS kit_bin, g.part AS component_product_number,
         g.part_edi AS component_prod_id, g.part_description AS component_description,
         g.quantity AS component_quantity_in_kit, coalesce(h.pieces, 0) AS qty_in_kit,
         l.pieces AS qty_avail_sh, l.label AS component_bin, e.pieces AS qty_avail_e01,
         sh.invalid_share AS percent_invalid,
         CAST(sum(g.quantity - coalesce(h.pieces, 0))
              OVER (PARTITION BY g.kit, g.serial_number) AS BIGINT) AS pieces_missing
  FROM grid g
  JOIN kit_place kp ON kp.kit = g.kit AND kp.label IS NOT NULL
  LEFT JOIN holding h ON h.kit = g.kit AND h.serial_number = g.serial_number
                     AND h.part_edi = g.part_edi
  LEFT JOIN share sh ON sh.kit = g.kit AND sh.kit_edi = g.kit_edi
  LEFT JOIN loose l ON l.part = g.part AND l.part_edi = g.part_edi
  LEFT JOIN elsewhere e ON e.edi = g.part_edi
),
standard AS (
  SELECT k.number AS kit_number, k.edi AS kit_edi, k.id AS kit_id, p.number AS product_number,
         p.edi, p.description, b.quantity AS component_qty_standard
  FROM central_kit c JOIN product k ON k.id = c.kit_id LEFT JOIN bom b ON b.kit_id = c.kit_id
  LEFT JOIN product p ON p.id = b.part_id
  WHERE k.number IS NOT NULL
),
need AS (
  SELECT kit_number, product_number AS component, CAST(sum(component_qty_standard) AS BIGINT)
         AS std_qty
  FROM standard WHERE product_number IS NOT NULL GROUP BY ALL
),
reported_unit AS (
  SELECT u.id, u.kit AS kit_number, s.number AS serial_number, u.kind, u.label
  FROM kit_unit u JOIN serial s ON s.id = u.serial_id
  WHERE s.number IS NOT NULL AND u.inventory = 3 AND u.kit NOT LIKE 'ZPB%'
    AND u.kit IN (SELECT kit FROM kit_place WHERE label IS NOT NULL)
),
held AS (
  SELECT u.kit_number, u.serial_number, p.number AS component,
         CAST(sum(h.available) AS BIGINT) AS pieces
  FROM here h JOIN reported_unit u ON u.id = h.holder JOIN product p ON p.id = h.product_id
  WHERE h.kind = 2 AND h.holder_type = 2 GROUP BY ALL
),
wanted AS (
  SELECT kit_number, serial_number,
         row_number() OVER (PARTITION BY kit_number ORDER BY serial_number) AS build_pos
  FROM (SELECT DISTINCT kit_number, serial_number FROM reported_unit WHERE {requested})
),
kit_slots AS (SELECT kit_number, count(*) AS slots FROM wanted GROUP BY kit_number)
"""

# The kit whose reports are asked for alone.
ONE_KIT = "K-000002"

INVALID_ONLY, ALL_ON_SITE = "kind = 4", "TRUE"

# Pieces in the pool: each once, or as often as the report shows them.
EXACT_POOL = """
pool AS (
  SELECT n.kit_number, n.component, n.std_qty, CAST(coalesce(sum(h.pieces), 0) AS BIGINT) AS pool
  FROM need n JOIN kit_slots USING (kit_number)
  LEFT JOIN (held JOIN wanted USING (kit_number, serial_number)) h
    ON h.kit_number = n.kit_number AND h.component = n.component
  GROUP BY ALL
)
"""
REPORTED_POOL = """
pool AS (
  SELECT n.kit_number, n.component, n.std_qty,
         CAST(coalesce(sum(r.qty_in_kit), 0) AS BIGINT) AS pool
  FROM need n JOIN kit_slots USING (kit_number)
  LEFT JOIN (report JOIN wanted ON wanted.kit_number = kit_product_number
             AND wanted.serial_number = report.serial_number) r
    ON r.kit_product_number = n.kit_number AND r.component_product_number = n.component
  GROUP BY ALL
)
"""
# A slot receives a component if the pool covers it and all slots before it.
REBUILD = """
line AS (
  SELECT w.kit_number, w.serial_number, w.build_pos, p.component, p.std_qty AS qty
  FROM wanted w JOIN pool p ON p.kit_number = w.kit_number AND p.pool >= p.std_qty * w.build_pos
),
slot AS (
  SELECT w.kit_number, w.serial_number, w.build_pos, count(l.component) AS components_in_kit,
         CASE WHEN count(l.component) = any_value(z.size) THEN 'valid' ELSE 'invalid' END AS status
  FROM wanted w
  JOIN (SELECT kit_number, count(*) AS size FROM need GROUP BY kit_number) z
    ON z.kit_number = w.kit_number
  LEFT JOIN line l ON l.kit_number = w.kit_number AND l.build_pos = w.build_pos
  GROUP BY w.kit_number, w.serial_number, w.build_pos
),
fill AS (
  SELECT p.kit_number, p.component, p.std_qty, p.pool, count(l.build_pos) AS fill,
         p.pool - p.std_qty * count(l.build_pos) AS leftover
  FROM pool p LEFT JOIN line l ON l.kit_number = p.kit_number AND l.component = p.component
  GROUP BY p.kit_number, p.component, p.std_qty, p.pool
)
"""

SUMMARY = """
SELECT s.kit_number, s.slots, s.valid_kits, s.slots - s.valid_kits AS invalid_kits,
       CAST(f.pieces AS BIGINT) AS total_pieces, CAST(f.leftover AS BIGINT) AS leftover_pieces
FROM (SELECT kit_number, count(*) AS slots, count(*) FILTER (status = 'valid') AS valid_kits
      FROM slot GROUP BY kit_number) s
JOIN (SELECT kit_number, sum(pool) AS pieces, sum(leftover) AS leftover
      FROM fill GROUP BY kit_number) f USING (kit_number)
"""

STATUS = "SELECT kit_number, serial_number, build_pos, components_in_kit, status FROM slot"

PLAIN = {
    "unique_kits": "SELECT kit_id AS product_id FROM central_kit",
    "loose_availability": """
        SELECT part AS product_number, part_edi AS edi_number, label AS component_bin,
               pieces AS qty_avail_sh FROM loose""",
    "kit_validity_by_type": """
        SELECT kit AS product_number, kit_edi AS edi_number, kit_description AS description,
               CASE kind WHEN 3 THEN units END AS valid, CASE kind WHEN 4 THEN units END AS invalid
        FROM kind_sum""",
    "kit_percent_invalid": """
        SELECT kit AS kit_prod_number, kit_edi, kit_description, coalesce(good, 0) AS valid,
               coalesce(bad, 0) AS invalid, CAST(invalid_share AS DOUBLE) AS percent_invalid
        FROM share""",
    "serial_contents": """
        SELECT kit AS kit_prod_number, kit_edi, kit_description, serial_number, label AS kit_bin,
               part AS component_product_number, part_edi AS component_edi,
               part_description AS component_description, pieces AS quantity_available
        FROM holding""",
    "warehouse_availability": "SELECT edi AS prod_id, pieces AS qty_avail_e01 FROM elsewhere",
    "kit_serials": "SELECT kit AS kit_product_number, kit_edi, serial_number FROM kit_serial",
    "kit_bins": """
        SELECT kit AS kit_prod_number, kit_edi, kit_description, label AS kit_bin
        FROM kit_place""",
    "kit_universe": """
        SELECT kit_id AS product_id, part_id AS component_product_id, quantity FROM kit_row""",
    "kit_components": """
        SELECT kit AS kit_product_number, kit_edi, kit_description,
               part AS component_product_number, part_edi AS component_prod_id,
               part_description AS component_description, quantity AS component_quantity_in_kit
        FROM named_row""",
    "kit_standard": "SELECT * FROM standard ORDER BY kit_number, product_number",
    "kit_standard_size": """
        SELECT kit_number, count(*) AS total_pieces FROM standard GROUP BY kit_number""",
    "kit_standard_map": """
        SELECT kit_number, product_number AS component, edi, description, component_qty_standard,
               count(*) OVER (PARTITION BY kit_number) AS total_pieces
        FROM standard WHERE product_number IS NOT NULL""",
    "serial_kit_grid": """
        SELECT kit AS kit_product_number, kit_edi, kit_description, serial_number,
               part AS component_product_number, part_edi AS component_prod_id,
               part_description AS component_description, quantity AS component_quantity_in_kit
        FROM grid""",
    "kit_breakout": """
        SELECT * REPLACE (CAST(percent_invalid AS DOUBLE) AS percent_invalid) FROM report
        ORDER BY percent_invalid DESC NULLS FIRST, kit_product_number, serial_number,
                 component_product_number""",
    "pieces_missing": """
        SELECT kit_product_number AS kit_number, serial_number,
               any_value(pieces_missing) AS pieces_missing
        FROM report GROUP BY ALL""",
    "serial_diff": """
        SELECT w.kit_number, w.serial_number, coalesce(max(r.pieces_missing), 0) AS pieces_missing,
               count(*) FILTER (r.qty_in_kit = 0) AS components_missing
        FROM wanted w LEFT JOIN report r
          ON r.kit_product_number = w.kit_number AND r.serial_number = w.serial_number
        GROUP BY ALL""",
    "serial_missing_components": """
        SELECT w.kit_number, w.serial_number, r.component_product_number, r.component_prod_id,
               r.component_description
        FROM wanted w JOIN report r
          ON r.kit_product_number = w.kit_number AND r.serial_number = w.serial_number
        WHERE r.qty_in_kit = 0""",
    "serial_breakout": """
        SELECT w.kit_number, w.serial_number, r.component_product_number, r.component_prod_id,
               r.component_description, r.qty_in_kit, r.qty_avail_sh, r.qty_avail_e01
        FROM wanted w LEFT JOIN report r
          ON r.kit_product_number = w.kit_number AND r.serial_number = w.serial_number""",
    "kit_breakout_corrected": """
        SELECT c.*, CAST(sum(component_quantity_in_kit - qty_in_kit)
                 OVER (PARTITION BY kit_product_number, serial_number) AS BIGINT) AS pieces_missing,
               CASE WHEN component_quantity_in_kit > qty_in_kit
                    THEN component_quantity_in_kit - qty_in_kit ELSE 0 END AS shortage
        FROM (
          SELECT u.kit_number AS kit_product_number, k.edi AS kit_edi,
                 k.description AS kit_description, u.serial_number, u.kit_bin,
                 n.component AS component_product_number, p.edi AS component_prod_id,
                 p.description AS component_description,
                 n.std_qty AS component_quantity_in_kit, coalesce(h.pieces, 0) AS qty_in_kit,
                 l.pieces AS qty_avail_sh, l.component_bin, l.component_bins,
                 e.pieces AS qty_avail_e01, CAST(s.invalid_share AS DOUBLE) AS percent_invalid
          FROM (SELECT kit_number, serial_number, min(label) AS kit_bin
                FROM reported_unit GROUP BY ALL) u
          JOIN product k ON k.number = u.kit_number
          JOIN need n ON n.kit_number = u.kit_number
          JOIN product p ON p.number = n.component
          LEFT JOIN held h ON h.kit_number = u.kit_number AND h.serial_number = u.serial_number
                          AND h.component = n.component
          LEFT JOIN (
            SELECT part, CAST(sum(pieces) AS BIGINT) AS pieces, count(*) AS component_bins,
                   list(label ORDER BY pieces DESC, label DESC)[1] AS component_bin
            FROM loose GROUP BY part) l ON l.part = n.component
          LEFT JOIN elsewhere e ON e.edi = p.edi
          LEFT JOIN share s ON s.kit = u.kit_number
        ) c""",
    "serial_diff_corrected": """
        SELECT w.kit_number, w.serial_number,
               CAST(sum(n.std_qty - coalesce(h.pieces, 0)) AS BIGINT) AS pieces_missing,
               count(*) FILTER (coalesce(h.pieces, 0) = 0) AS components_missing,
               CAST(sum(greatest(n.std_qty - coalesce(h.pieces, 0), 0)) AS BIGINT) AS shortage
        FROM wanted w JOIN need n ON n.kit_number = w.kit_number
        LEFT JOIN held h ON h.kit_number = w.kit_number AND h.serial_number = w.serial_number
                        AND h.component = n.component
        GROUP BY ALL""",
    "invalid_serial_requests": "SELECT kit_number, serial_number, build_pos FROM wanted",
    "breakout_documents": """
        SELECT w.kit_number, w.serial_number, coalesce(r.pieces_missing, 0) AS pieces_missing,
               r.component_product_number, r.component_prod_id, r.component_description,
               r.qty_in_kit, r.qty_avail_sh, r.qty_avail_e01,
               coalesce(r.qty_in_kit = 0, FALSE) AS missing
        FROM wanted w LEFT JOIN report r
          ON r.kit_product_number = w.kit_number AND r.serial_number = w.serial_number""",
}
# Rows that are equal in the report's order follow by all columns.
_TIES = ", ".join(
    f"{c} NULLS FIRST"
    for c in (
        "kit_product_number kit_edi kit_description serial_number kit_bin component_product_number "
        "component_prod_id component_description component_quantity_in_kit qty_in_kit qty_avail_sh "
        "component_bin qty_avail_e01 percent_invalid pieces_missing"
    ).split()
)
PLAIN |= {
    "standard_pages": """
        SELECT kit_number, total_pieces, page, count(*) AS entries,
               string_agg(component || ':' || CAST(component_qty_standard AS VARCHAR), ' ' ORDER BY component) AS listed
        FROM (
          SELECT kit_number, component, component_qty_standard, total_pieces,
                 CAST(floor((row_number() OVER (PARTITION BY kit_number ORDER BY component) - 1) / 8) AS BIGINT) AS page
          FROM (SELECT kit_number, product_number AS component, component_qty_standard,
                       count(*) OVER (PARTITION BY kit_number) AS total_pieces
                FROM standard WHERE product_number IS NOT NULL))
        GROUP BY ALL""",
    "kit_standard_in_order": """
        SELECT *, row_number() OVER (
            ORDER BY kit_number NULLS LAST, product_number NULLS LAST, kit_edi NULLS FIRST,
                     kit_id NULLS FIRST, edi NULLS FIRST, description NULLS FIRST,
                     component_qty_standard NULLS FIRST) AS position
        FROM standard""",
    "kit_breakout_in_order": f"""
        SELECT *, row_number() OVER (
            ORDER BY percent_invalid DESC NULLS FIRST, kit_product_number NULLS LAST,
                     serial_number NULLS LAST, component_product_number NULLS LAST, {_TIES}) AS position
        FROM (SELECT * REPLACE (CAST(percent_invalid AS DOUBLE) AS percent_invalid) FROM report)""",
    "standard_documents": PLAIN["kit_standard_map"],
    "kit_standard_one": f"SELECT * FROM standard WHERE kit_number = '{ONE_KIT}'",
    "kit_standard_function": f"SELECT * FROM standard WHERE kit_number = '{ONE_KIT}'",
    "kit_breakout_one": f"""
        SELECT * REPLACE (CAST(percent_invalid AS DOUBLE) AS percent_invalid) FROM report
        WHERE kit_product_number = '{ONE_KIT}'""",
    "kit_breakout_function": f"""
        SELECT * REPLACE (CAST(percent_invalid AS DOUBLE) AS percent_invalid) FROM report
        WHERE kit_product_number = '{ONE_KIT}'""",
}

# name -> (statement, pool, requested serials)
REBUILT = {
    "component_pool": ("SELECT * FROM pool", EXACT_POOL, INVALID_ONLY),
    "component_fill": ("SELECT * EXCLUDE (leftover) FROM fill", EXACT_POOL, INVALID_ONLY),
    "component_leftover": ("SELECT * FROM fill", EXACT_POOL, INVALID_ONLY),
    "component_pool_as_reported": ("SELECT * FROM pool", REPORTED_POOL, INVALID_ONLY),
    "assembly_serial_status": (STATUS, EXACT_POOL, INVALID_ONLY),
    "assembly_serial_status_as_reported": (STATUS, REPORTED_POOL, INVALID_ONLY),
    "assembly_build_lines": ("SELECT * FROM line", EXACT_POOL, INVALID_ONLY),
    "assembly_serial_report": (
        "SELECT kit_number, serial_number, status, components_in_kit FROM slot",
        EXACT_POOL,
        INVALID_ONLY,
    ),
    "assembly_serial_sheets": (
        """SELECT l.kit_number, l.serial_number, upper(s.status) AS status, l.component,
                  l.qty AS qty_in_kit
           FROM line l JOIN slot s USING (kit_number, build_pos)""",
        EXACT_POOL,
        INVALID_ONLY,
    ),
    "component_count_documents": (
        """SELECT kit_number, CAST(sum(pool) OVER (PARTITION BY kit_number) AS BIGINT)
                  AS total_pieces, component, leftover FROM fill""",
        EXACT_POOL,
        INVALID_ONLY,
    ),
    "assembly_nested": (
        """SELECT s.kit_number, s.build_pos, s.serial_number AS serial, s.status, l.component, l.qty
           FROM slot s LEFT JOIN line l USING (kit_number, build_pos)""",
        EXACT_POOL,
        INVALID_ONLY,
    ),
    "reassembly_summary": (SUMMARY, EXACT_POOL, INVALID_ONLY),
    "reassembly_summary_as_reported": (SUMMARY, REPORTED_POOL, INVALID_ONLY),
    "reassembly_summary_all_serials": (SUMMARY, EXACT_POOL, ALL_ON_SITE),
    "reassembly_summary_all_serials_as_reported": (SUMMARY, REPORTED_POOL, ALL_ON_SITE),
}


def _statement(select: str, requested: str = INVALID_ONLY, *more: str) -> str:
    relations = [SOURCES, RELATIONS.replace("{requested}", requested), *more]
    return "WITH " + ",".join(part.strip("\n") for part in relations) + "\n" + select.strip()


def statements() -> dict[str, str]:
    plain = {name: _statement(select) for name, select in PLAIN.items()}
    rebuilt = {
        name: _statement(select, requested, pool, REBUILD)
        for name, (select, pool, requested) in REBUILT.items()
    }
    return plain | rebuilt
