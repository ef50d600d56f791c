import pytest

from quarrylane.operators import sqltext
from quarrylane.operators.sqltext import procedures, read, table_crud


def crud(sql):
    return {t: "".join(x) for t, x in table_crud(read(sql)).items()}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a.x FROM TB_A a JOIN TB_B b ON a.id = b.id", {"TB_A": "R", "TB_B": "R"}),
        ("SELECT x FROM TB_A FOR UPDATE", {"TB_A": "R"}),
        ("MERGE INTO TB_T t USING (SELECT s.a FROM TB_S s, TB_U u WHERE s.id = u.id) q ON (t.id = q.id) WHEN MATCHED THEN UPDATE SET t.a = q.a WHEN NOT MATCHED THEN INSERT (id, a) VALUES (q.id, q.a)", {"TB_T": "CU", "TB_S": "R", "TB_U": "R"}),
        ("MERGE INTO TB_T t USING TB_S s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET t.a = s.a", {"TB_T": "U", "TB_S": "R"}),
        ("UPDATE TB_A SET x = (SELECT y FROM TB_LOOK WHERE k = 1) WHERE id = 2", {"TB_A": "U", "TB_LOOK": "R"}),
        ("INSERT INTO own.TB_A (a, b) SELECT s.a, t.b FROM TB_S s JOIN TB_T t ON s.i = t.i", {"TB_A": "C", "TB_S": "R", "TB_T": "R"}),
        ("DELETE FROM TB_A WHERE id IN (SELECT id FROM TB_B)", {"TB_A": "D", "TB_B": "R"}),
        ("DELETE TB_A WHERE id = 1", {"TB_A": "D"}),
        ("WITH w AS (SELECT a FROM TB_A) SELECT * FROM w, TB_B b", {"TB_A": "R", "TB_B": "R"}),
        ("SELECT * FROM (SELECT a FROM TB_A) x, TB_B y, own.TB_C", {"TB_A": "R", "TB_B": "R", "TB_C": "R"}),
        ("SELECT 1 FROM DUAL", {}),
        ("", {}),
        (None, {}),
        ("not sql at all ((", {}),
    ],
)
def test_roles(sql, want):
    assert crud(sql) == want


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 1 FROM A x INNER JOIN B y ON x.c = y.d", [("A", "C", "B", "D", "INNER JOIN")]),
        ("SELECT 1 FROM A x LEFT JOIN B y ON x.c = y.d", [("A", "C", "B", "D", "LEFT JOIN")]),
        ("SELECT 1 FROM A, B WHERE A.c = B.d", [("A", "C", "B", "D", "WHERE (implicit)")]),
        ("SELECT 1 FROM A a, B b WHERE 1 = 1 AND 'xxxxxxxxxxxxxxxxxxxxxxxxxxxx' = a.z AND a.c = b.d (+)", [("A", "C", "B", "D", "LEFT OUTER JOIN (Oracle +)")]),
        ("SELECT 1 FROM A a, B b WHERE a.c(+) = b.d", [("A", "C", "B", "D", "RIGHT OUTER JOIN (Oracle +)")]),
        ("SELECT 1 FROM A a, B b WHERE a.c(+) = b.d(+)", [("A", "C", "B", "D", "FULL OUTER JOIN")]),
        ("SELECT 1 FROM own.A a JOIN own.B b ON a.c = b.d", [("A", "C", "B", "D", "INNER JOIN")]),
        ("SELECT 1 FROM A a JOIN A b ON a.c = b.c", []),
        ("SELECT x, y FROM A MINUS SELECT p, q FROM B", [("A", "X", "B", "P", "MINUS"), ("A", "Y", "B", "Q", "MINUS")]),
        ("SELECT * FROM A MINUS SELECT * FROM B", [("A", "*", "B", "*", "MINUS")]),
        ("SELECT x FROM A UNION SELECT y FROM B", []),
        ("WITH w AS (SELECT c FROM A) SELECT 1 FROM w JOIN B b ON w.c = b.d", []),
        ("SELECT 1 FROM A a WHERE EXISTS (SELECT 1 FROM B b WHERE b.i = a.i)", [("B", "I", "A", "I", "WHERE (implicit)")]),
    ],
)
def test_joins(sql, want):
    assert read(sql).joins == want


def test_columns():
    assert read("SELECT a.x AS y, b.z, count(*) FROM A a JOIN B b ON a.i = b.i").columns == [("A", "X", "R"), ("B", "Z", "R")]
    assert read("SELECT x, y FROM A").columns == [("A", "X", "R"), ("A", "Y", "R")]
    assert read("SELECT x FROM A, B").columns == []
    assert read("SELECT * FROM A").columns == []
    assert read("UPDATE A t SET t.p = 1, q = f(2, 3) WHERE r = 1").columns == [("A", "P", "U"), ("A", "Q", "U")]
    assert sorted(read("INSERT INTO A (p, q) VALUES (?, ?)").columns) == [("A", "P", "C"), ("A", "Q", "C")]
    assert read("DELETE FROM A WHERE x = 1").columns == []


def test_main_table_and_letters():
    assert read("INSERT INTO A SELECT 1 FROM B").main == "A"
    assert read("SELECT 1 FROM (SELECT 1 FROM B) x, C").main == "C"
    assert read("/* DELETE */ SELECT 'UPDATE' FROM A FOR UPDATE").letters == ["R"]
    assert read("INSERT INTO A SELECT 1 FROM B").letters == ["C", "R"]


def test_procedures():
    assert procedures("{CALL p.q(?)}") == ["P.Q"]
    assert procedures("EXEC a(1) CALL b(2) {call c(3)}") == ["C", "B", "A"]
    assert procedures("BEGIN DBMS_OUTPUT.PUT_LINE(1); END") == []
    assert procedures(None) == []


def test_long_statement():
    sql = "SELECT " + ", ".join(f"a.c{i}" for i in range(3000)) + " FROM A a"
    assert len(read(sql).columns) == 3000 and len(sqltext.tokens(sql)) > 6000
