"""Statements made from the rows of ``nation`` with the edges that they must give: {n} is a nation, {r} its region.

The expected edges are stated for the rows, not read from the text; SQL spells them out without seeing a statement.
"""

STATEMENTS: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "insert_select_edges": ("INSERT INTO SYN.T{n} (A, B) SELECT s.X, s.Y FROM SYN.S{r} s WHERE s.Z > {n}", [("SYN.T{n}.A", "SYN.S{r}.X", "DIRECT"), ("SYN.T{n}.B", "SYN.S{r}.Y", "DIRECT"), ("SYN.T{n}.*", "SYN.S{r}.Z", "INDIRECT_FILTER")]),
    "insert_join_edges": ("INSERT INTO SYN.T{n} (A, B) SELECT s.X, NVL(d.Y, 0) + s.W FROM SYN.S{r} s LEFT JOIN SYN.D{n} d ON s.K = d.K", [("SYN.T{n}.A", "SYN.S{r}.X", "DIRECT"), ("SYN.T{n}.B", "SYN.D{n}.Y", "TRANSFORM"), ("SYN.T{n}.B", "SYN.S{r}.W", "TRANSFORM"), ("SYN.T{n}.*", "SYN.S{r}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.D{n}.K", "INDIRECT_FILTER")]),
    "insert_values_edges": ("INSERT INTO SYN.T{n} (A, B, C) VALUES ({n}, (SELECT MAX(s.X) FROM SYN.S{r} s), 'x')", [("SYN.T{n}.B", "SYN.S{r}.X", "TRANSFORM")]),
    "update_edges": ("UPDATE SYN.T{n} t SET t.A = NVL((SELECT SUM(s.Q) FROM SYN.S{r} s WHERE s.K = t.K), 0), t.B = {n} WHERE t.D < SYSDATE", [("SYN.T{n}.A", "SYN.S{r}.Q", "TRANSFORM"), ("SYN.T{n}.A", "SYN.S{r}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.T{n}.D", "INDIRECT_FILTER")]),
    "delete_filters": ("DELETE FROM SYN.T{n} t WHERE t.D < SYSDATE - {n} AND t.K IN (SELECT g.K FROM SYN.G{r} g)", [("SYN.T{n}.*", "SYN.T{n}.D", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.T{n}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.G{r}.K", "INDIRECT_FILTER")]),
    "merge_edges": ("MERGE INTO SYN.T{n} t USING (SELECT a.K, a.Q FROM SYN.A{r} a WHERE a.D > 1) s ON (t.K = s.K) WHEN MATCHED THEN UPDATE SET t.Q = s.Q WHEN NOT MATCHED THEN INSERT (K, Q) VALUES (s.K, s.Q)", [("SYN.T{n}.Q", "SYN.A{r}.Q", "DIRECT"), ("SYN.T{n}.K", "SYN.A{r}.K", "DIRECT"), ("SYN.T{n}.*", "SYN.T{n}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.A{r}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.A{r}.D", "INDIRECT_FILTER")]),
    "cte_edges": ("INSERT INTO SYN.T{n} (A, B) WITH c AS (SELECT f.K, SUM(f.V) TOT FROM SYN.F{r} f GROUP BY f.K) SELECT c.K, c.TOT FROM c", [("SYN.T{n}.A", "SYN.F{r}.K", "VIA_CTE"), ("SYN.T{n}.B", "SYN.F{r}.V", "VIA_CTE")]),
    "inline_view_edges": ("INSERT INTO SYN.T{n} (A, B) SELECT v.X, v.Y * 2 FROM (SELECT p.X, p.Y FROM SYN.P{r} p WHERE p.Z = 1) v", [("SYN.T{n}.A", "SYN.P{r}.X", "VIA_CTE"), ("SYN.T{n}.B", "SYN.P{r}.Y", "TRANSFORM")]),
    "star_edges": ("INSERT INTO SYN.MIRROR SELECT s.* FROM SYN.ORIGIN s WHERE s.ID = {n}", [("SYN.MIRROR.ID", "SYN.ORIGIN.ID", "DIRECT"), ("SYN.MIRROR.NAME", "SYN.ORIGIN.NAME", "DIRECT"), ("SYN.MIRROR.*", "SYN.ORIGIN.ID", "INDIRECT_FILTER")]),
    "pivot_edges": ("INSERT INTO SYN.T{n} (R, J, F) SELECT p.R, p.JAN, p.FEB FROM (SELECT s.M, s.Q, s.R FROM SYN.S{r} s) PIVOT (SUM(Q) FOR M IN ('1' AS JAN, '2' AS FEB)) p", [("SYN.T{n}.R", "SYN.S{r}.R", "VIA_CTE"), ("SYN.T{n}.J", "SYN.S{r}.Q", "VIA_CTE"), ("SYN.T{n}.F", "SYN.S{r}.Q", "VIA_CTE"), ("SYN.T{n}.*", "SYN.S{r}.M", "INDIRECT_FILTER")]),
    "pivot_table_edges": ("INSERT INTO SYN.T{n} (R, J) SELECT p.R, p.JAN FROM SYN.S{r} PIVOT (SUM(Q) FOR M IN ('1' AS JAN)) p", [("SYN.T{n}.R", "SYN.S{r}.R", "DIRECT"), ("SYN.T{n}.J", "SYN.S{r}.Q", "DIRECT"), ("SYN.T{n}.*", "SYN.S{r}.M", "INDIRECT_FILTER")]),
    "unpivot_edges": ("INSERT INTO SYN.T{n} (K, V, M) SELECT u.K, u.VAL, u.MON FROM SYN.S{r} UNPIVOT (VAL FOR MON IN (JAN, FEB)) u", [("SYN.T{n}.K", "SYN.S{r}.K", "DIRECT"), ("SYN.T{n}.V", "SYN.S{r}.JAN", "DIRECT"), ("SYN.T{n}.V", "SYN.S{r}.FEB", "DIRECT")]),
    "case_decode_edges": ("INSERT INTO SYN.T{n} (A, B) SELECT CASE WHEN s.C = {n} THEN s.X ELSE s.Y END, DECODE(s.D, 1, s.U, s.V) FROM SYN.S{r} s", [("SYN.T{n}.A", "SYN.S{r}.X", "TRANSFORM"), ("SYN.T{n}.A", "SYN.S{r}.Y", "TRANSFORM"), ("SYN.T{n}.A", "SYN.S{r}.C", "INDIRECT_FILTER"), ("SYN.T{n}.B", "SYN.S{r}.U", "TRANSFORM"), ("SYN.T{n}.B", "SYN.S{r}.V", "TRANSFORM"), ("SYN.T{n}.B", "SYN.S{r}.D", "INDIRECT_FILTER")]),
    "aggregate_edges": ("INSERT INTO SYN.T{n} (A, B, C) SELECT s.K, SUM(s.Q), COUNT(*) FROM SYN.S{r} s GROUP BY s.K HAVING SUM(s.Q) > 0", [("SYN.T{n}.A", "SYN.S{r}.K", "DIRECT"), ("SYN.T{n}.B", "SYN.S{r}.Q", "AGGREGATE"), ("SYN.T{n}.*", "SYN.S{r}.K", "INDIRECT_FILTER")]),
    "analytic_edges": ("INSERT INTO SYN.T{n} (A, B) SELECT s.K, RANK() OVER (PARTITION BY s.G ORDER BY SUM(s.Q) DESC) FROM SYN.S{r} s GROUP BY s.K, s.G", [("SYN.T{n}.A", "SYN.S{r}.K", "DIRECT"), ("SYN.T{n}.B", "SYN.S{r}.G", "ANALYTIC"), ("SYN.T{n}.B", "SYN.S{r}.Q", "ANALYTIC"), ("SYN.T{n}.*", "SYN.S{r}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.S{r}.G", "INDIRECT_FILTER")]),
    "scalar_subquery_edges": ("INSERT INTO SYN.T{n} (A) SELECT (SELECT d.NM FROM SYN.D{r} d WHERE d.K = s.K) FROM SYN.S{n} s", [("SYN.T{n}.A", "SYN.D{r}.NM", "TRANSFORM"), ("SYN.T{n}.A", "SYN.D{r}.K", "INDIRECT_FILTER"), ("SYN.T{n}.A", "SYN.S{n}.K", "INDIRECT_FILTER")]),
    "connect_by_filters": ("INSERT INTO SYN.T{n} (A, L) SELECT h.NM, LEVEL FROM SYN.H{r} h START WITH h.PID IS NULL CONNECT BY PRIOR h.ID = h.PID", [("SYN.T{n}.A", "SYN.H{r}.NM", "DIRECT"), ("SYN.T{n}.*", "SYN.H{r}.PID", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.H{r}.ID", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.H{r}.PID", "INDIRECT_FILTER")]),
    "outer_join_marker_edges": ("INSERT INTO SYN.T{n} (A, B) SELECT a.X, b.Y FROM SYN.A{n} a, SYN.B{r} b WHERE a.K = b.K(+)", [("SYN.T{n}.A", "SYN.A{n}.X", "DIRECT"), ("SYN.T{n}.B", "SYN.B{r}.Y", "DIRECT"), ("SYN.T{n}.*", "SYN.A{n}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.B{r}.K", "INDIRECT_FILTER")]),
    "dblink_edges": ("INSERT INTO SYN.T{n} (A) SELECT a.X FROM SYN.A{r}@ERPLINK a", [("SYN.T{n}.A", "SYN.A{r}@ERPLINK.X", "DIRECT")]),
    "exists_filters": ("INSERT INTO SYN.T{n} (A) SELECT s.X FROM SYN.S{n} s WHERE EXISTS (SELECT 1 FROM SYN.E{r} e WHERE e.K = s.K)", [("SYN.T{n}.A", "SYN.S{n}.X", "DIRECT"), ("SYN.T{n}.*", "SYN.E{r}.K", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.S{n}.K", "INDIRECT_FILTER")]),
    "unqualified_edges": ("INSERT INTO SYN.T{n} (A, B) SELECT X, Y || Z FROM SYN.S{r}", [("SYN.T{n}.A", "SYN.S{r}.X", "DIRECT"), ("SYN.T{n}.B", "SYN.S{r}.Y", "TRANSFORM"), ("SYN.T{n}.B", "SYN.S{r}.Z", "TRANSFORM")]),
    "function_from_edges": ("INSERT INTO SYN.T{n} (A, B, C) SELECT TRIM(BOTH ' ' FROM s.X), EXTRACT(YEAR FROM s.D), MAX(s.Q) KEEP (DENSE_RANK LAST ORDER BY s.G) FROM SYN.S{r} s", [("SYN.T{n}.A", "SYN.S{r}.X", "TRANSFORM"), ("SYN.T{n}.B", "SYN.S{r}.D", "TRANSFORM"), ("SYN.T{n}.C", "SYN.S{r}.Q", "AGGREGATE"), ("SYN.T{n}.C", "SYN.S{r}.G", "AGGREGATE")]),
    "insert_all_edges": ("INSERT ALL WHEN F = 1 THEN INTO SYN.T{n} (A) VALUES (X) ELSE INTO SYN.U{r} (B, C) VALUES (Y, {n}) SELECT s.X, s.Y, s.F FROM SYN.S{r} s WHERE s.Z > {n}", [("SYN.T{n}.A", "SYN.S{r}.X", "DIRECT"), ("SYN.U{r}.B", "SYN.S{r}.Y", "DIRECT"), ("SYN.T{n}.*", "SYN.S{r}.F", "INDIRECT_FILTER"), ("SYN.T{n}.*", "SYN.S{r}.Z", "INDIRECT_FILTER"), ("SYN.U{r}.*", "SYN.S{r}.Z", "INDIRECT_FILTER")]),
    "hint_edges": ("INSERT /*+ APPEND */ INTO SYN.T{n} (A) SELECT /*+ PARALLEL(s 4) */ s.X -- all\n FROM SYN.S{r} s", [("SYN.T{n}.A", "SYN.S{r}.X", "DIRECT")]),
}

#: Whole sources: the body of a subprogram and its declarations.
FLOWS: dict[str, tuple[str, str, list[tuple[str, str, str]]]] = {
    "select_into_values": ("v_x NUMBER; v_y NUMBER;", "SELECT a.X, a.Y INTO v_x, v_y FROM SYN.A{r} a WHERE a.K = {n}; INSERT INTO SYN.T{n} (A, B) VALUES (v_x, v_y + 1);", [("SYN.T{n}.A", "SYN.A{r}.X", "VIA_VARIABLE"), ("SYN.T{n}.B", "SYN.A{r}.Y", "VIA_VARIABLE")]),
    "bulk_collect_forall": ("TYPE t IS TABLE OF SYN.S%ROWTYPE; t_rows t;", "SELECT s.ID, s.W BULK COLLECT INTO t_rows FROM SYN.S{r} s; FORALL i IN 1 .. t_rows.COUNT UPDATE SYN.T{n} SET W = t_rows(i).W WHERE ID = {n};", [("SYN.T{n}.W", "SYN.S{r}.W", "VIA_VARIABLE"), ("SYN.T{n}.*", "SYN.T{n}.ID", "INDIRECT_FILTER")]),
    "cursor_loop": ("CURSOR c_a IS SELECT s.ID, s.Q FROM SYN.S{r} s;", "FOR r IN c_a LOOP INSERT INTO SYN.T{n} (ID, Q) VALUES (r.ID, r.Q); END LOOP;", [("SYN.T{n}.ID", "SYN.S{r}.ID", "VIA_VARIABLE"), ("SYN.T{n}.Q", "SYN.S{r}.Q", "VIA_VARIABLE")]),
    "query_loop": ("", "FOR r IN (SELECT s.ID, MAX(s.Q) MX FROM SYN.S{r} s GROUP BY s.ID) LOOP INSERT INTO SYN.T{n} (ID, Q) VALUES (r.ID, r.MX); END LOOP;", [("SYN.T{n}.ID", "SYN.S{r}.ID", "VIA_VARIABLE"), ("SYN.T{n}.Q", "SYN.S{r}.Q", "VIA_VARIABLE")]),
    "rowtype_field": ("r_a SYN.R{r}%ROWTYPE;", "INSERT INTO SYN.T{n} (A) VALUES (r_a.NM);", [("SYN.T{n}.A", "SYN.R{r}.NM", "VIA_VARIABLE")]),
    "rowtype_shadowed": ("r_a SYN.R{r}%ROWTYPE; v_x NUMBER;", "SELECT a.X INTO v_x FROM SYN.A{n} a; r_a.NM := 'x'; r_a.ID := v_x; INSERT INTO SYN.T{n} (A, B) VALUES (r_a.NM, r_a.ID);", [("SYN.T{n}.B", "SYN.A{n}.X", "VIA_VARIABLE")]),
    "type_anchor_not_source": ("v_x SYN.A{r}.X%TYPE;", "INSERT INTO SYN.T{n} (A, B) SELECT v_x, s.Y FROM SYN.S{r} s;", [("SYN.T{n}.B", "SYN.S{r}.Y", "DIRECT")]),
    "assignment_chain": ("v_a NUMBER; v_b NUMBER; v_c NUMBER;", "SELECT a.X INTO v_a FROM SYN.A{r} a; v_b := v_a * 2; v_c := NVL(v_b, 0); INSERT INTO SYN.T{n} (A) VALUES (v_c);", [("SYN.T{n}.A", "SYN.A{r}.X", "VIA_VARIABLE")]),
    "accumulate_var": ("v_sum NUMBER := 0;", "FOR q IN (SELECT s.Q FROM SYN.S{r} s) LOOP v_sum := NVL(v_sum, 0) + q.Q; END LOOP; UPDATE SYN.T{n} SET S = v_sum;", [("SYN.T{n}.S", "SYN.S{r}.Q", "VIA_VARIABLE")]),
    "literal_keeps_binding": ("v_a NUMBER;", "SELECT a.X INTO v_a FROM SYN.A{r} a; v_a := 0; INSERT INTO SYN.T{n} (A) VALUES (v_a);", [("SYN.T{n}.A", "SYN.A{r}.X", "VIA_VARIABLE")]),
    "control_flow_edges": ("v_a NUMBER;", "IF v_a > {n} THEN INSERT INTO SYN.T{n} (A) SELECT s.X FROM SYN.S{r} s; ELSIF v_a = 0 THEN DELETE FROM SYN.U{n} WHERE K = 1; ELSE BEGIN UPDATE SYN.V{n} SET B = C; EXCEPTION WHEN OTHERS THEN NULL; END; END IF;", [("SYN.T{n}.A", "SYN.S{r}.X", "DIRECT"), ("SYN.U{n}.*", "SYN.U{n}.K", "INDIRECT_FILTER"), ("SYN.V{n}.B", "SYN.V{n}.C", "DIRECT")]),
}

#: Statements with the diagnostic that they must give.
DIAGNOSED: dict[str, tuple[str, str]] = {
    "param_unresolved_diag": ("INSERT INTO SYN.T{n} (A) VALUES (P_{n});", "PARAMETER_UNRESOLVED"),
    "ambiguous_name_diag": ("INSERT INTO SYN.T{n} (A) SELECT X FROM SYN.A{r}, SYN.B{n};", "UNRESOLVED"),
    "unknown_name_diag": ("INSERT INTO SYN.T{n} (A) VALUES (v_{n});", "UNRESOLVED"),
    "star_unresolved_diag": ("INSERT INTO SYN.T{n} (A) SELECT s.* FROM SYN.S{r} s;", "STAR_UNRESOLVED"),
    "dynamic_diag": ("EXECUTE IMMEDIATE v_{n};", "DYNAMIC_SQL"),
    "dynamic_partial_diag": ("EXECUTE IMMEDIATE 'INSERT INTO SYN.L{n} (A) SELECT B FROM SYN.Q{r} WHERE X = ' || v_x;", "DYNAMIC_SQL_PARTIAL"),
    "bare_select_diag": ("SELECT {n} FROM DUAL;", "SQL_NOT_ANALYZED"),
    "recursive_cte_diag": ("INSERT INTO SYN.T{n} (A) WITH c AS (SELECT 1 K FROM DUAL UNION ALL SELECT K + 1 FROM c) SELECT c.K FROM c;", "UNSUPPORTED_CTE"),
    "set_operation_diag": ("INSERT INTO SYN.T{n} (A) SELECT X FROM SYN.A{r} UNION SELECT Y FROM SYN.B{r};", "SET_OP_UNANALYZED"),
    "dblink_diag": ("INSERT INTO SYN.T{n} (A) SELECT a.X FROM SYN.A{r}@L@M a;", "DB_LINK_UNRESOLVED"),
}

#: Statements with their table relations: (source, target, operation).
RELATED: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "statement_relations": ("INSERT INTO SYN.T{n} (A) WITH c AS (SELECT X FROM SYN.A{r}) SELECT c.X FROM c, SYN.B{n} b WHERE b.K IN (SELECT K FROM SYN.G{r});", [("SYN.A{r}", "SYN.T{n}", "INSERT"), ("SYN.B{n}", "SYN.T{n}", "INSERT"), ("SYN.G{r}", "SYN.T{n}", "INSERT")]),
    "merge_relations": ("MERGE INTO SYN.T{n} t USING SYN.A{r} s ON (t.K = s.K) WHEN MATCHED THEN UPDATE SET t.Q = (SELECT MAX(z.Q) FROM SYN.Z{n} z);", [("SYN.A{r}", "SYN.T{n}", "MERGE"), ("SYN.Z{n}", "SYN.T{n}", "MERGE")]),
    "update_relations": ("UPDATE SYN.T{n} t SET A = (SELECT MAX(x.Q) FROM SYN.X{r} x) WHERE EXISTS (SELECT 1 FROM SYN.T{n} u WHERE u.K = t.K);", [("SYN.X{r}", "SYN.T{n}", "UPDATE"), ("SYN.T{n}", "SYN.T{n}", "UPDATE")]),
    "function_from_relations": ("INSERT INTO SYN.T{n} (A) SELECT TRIM(LEADING '0' FROM s.X) FROM (SYN.S{r} s JOIN SYN.D{n} d ON s.K = d.K) WHERE EXTRACT(YEAR FROM d.D) > {n};", [("SYN.S{r}", "SYN.T{n}", "INSERT"), ("SYN.D{n}", "SYN.T{n}", "INSERT")]),
    "insert_all_relations": ("INSERT ALL INTO SYN.T{n} (A) VALUES (X) INTO SYN.U{n} (B) VALUES (X) SELECT s.X FROM SYN.S{r} s;", [("SYN.S{r}", "SYN.T{n}", "INSERT"), ("SYN.S{r}", "SYN.U{n}", "INSERT")]),
    "dynamic_literal_relations": ("EXECUTE IMMEDIATE q'[INSERT INTO SYN.L{n} (A) SELECT B FROM SYN.Q{r}]';", [("SYN.Q{r}", "SYN.L{n}", "INSERT")]),
}

#: Interfaces: steps, and the (target, source, kind, hops) that they must give; no source is an empty string.
PIPELINES: dict[str, tuple[str, list[tuple[str, str, str, int]]]] = {
    "pipeline_edges": ('[{"op":"select","fields":{"in/a":"SRC.S{n}.A","in/b":"SRC.S{n}.B"},"where":["SRC.S{n}.F"]},{"op":"copy","from":"in/a","to":"doc/x"},{"op":"copy","from":"doc/x","to":"out/x"},{"op":"insert","table":"TGT.T{r}","columns":{"X":{"path":"out/x"},"B":{"path":"in/b"},"U":{"path":"in/b","expr":"UPPER(?)"}}}]', [("TGT.T{r}.X", "SRC.S{n}.A", "VIA_PIPELINE", 3), ("TGT.T{r}.B", "SRC.S{n}.B", "DIRECT", 1), ("TGT.T{r}.U", "SRC.S{n}.B", "TRANSFORM", 1), ("TGT.T{r}.*", "SRC.S{n}.F", "FILTER", 1)]),
    "severed_edges": ('[{"op":"select","fields":{"in/a":"SRC.S{n}.A","in/b":"SRC.S{n}.B"}},{"op":"delete","path":"in"},{"op":"insert","table":"TGT.T{r}","columns":{"A":{"path":"in/a"},"Z":{"path":"none"}}}]', [("TGT.T{r}.A", "", "SEVERED", 1), ("TGT.T{r}.Z", "", "SEVERED", 1)]),
    "constant_edges": ('[{"op":"set","to":"k","value":"{n}"},{"op":"copy","from":"k","to":"o/k"},{"op":"insert","table":"TGT.T{r}","columns":{"K":{"path":"o/k"}}}]', [("TGT.T{r}.K", "", "CONSTANT", 1)]),
    "branch_filters": ('[{"op":"select","fields":{"a":"SRC.S{n}.A","s":"SRC.S{n}.ST"}},{"op":"branch","on":"s","cases":[[{"op":"copy","from":"a","to":"x"},{"op":"delete","path":"a"}],[{"op":"update","table":"TGT.U{r}","columns":{"A":{"path":"a"}}}]]},{"op":"insert","table":"TGT.T{r}","columns":{"A":{"path":"a"},"X":{"path":"x"}}}]', [("TGT.U{r}.A", "SRC.S{n}.A", "DIRECT", 1), ("TGT.U{r}.*", "SRC.S{n}.ST", "FILTER", 1), ("TGT.T{r}.A", "SRC.S{n}.A", "DIRECT", 1), ("TGT.T{r}.X", "SRC.S{n}.A", "VIA_PIPELINE", 2)]),
    "invoke_edges": ('[{"op":"select","fields":{"a":"SRC.S{n}.A","b":"SRC.S{n}.B"}},{"op":"loop","steps":[{"op":"invoke","service":"concat","inputs":["a","b","gone"],"output":"c"},{"op":"clear","preserve":["c"]},{"op":"insert","table":"TGT.T{r}","columns":{"C":{"path":"c"},"A":{"path":"a"}}}]}]', [("TGT.T{r}.C", "SRC.S{n}.A", "TRANSFORM", 2), ("TGT.T{r}.C", "SRC.S{n}.B", "TRANSFORM", 2), ("TGT.T{r}.A", "", "SEVERED", 1)]),
    "custom_sql_edges": ('[{"op":"sql","table":"TGT.T{r}","text":"CALL P{n}()"}]', [("TGT.T{r}.*", "", "UNRESOLVED", 1)]),
}
