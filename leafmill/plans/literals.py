"""Small literal tables, alike for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Rows = tuple[str, list[tuple]]

#: Texts around the damage rules: words, codes, telephone numbers, glued signs.
TEXTS: Rows = (
    "id int, text string",
    [
        (1, "Введение в предмет и метод"),
        (2, "Гла)а 1. ,)еде-ие"),
        (3, "(Spoerl, 1975) and others"),
        (4, "1ГЛОР(23 тест"),
        (5, "34567 I"),
        (6, "тел. 703-73, с 1990-х как-то"),
        (7, "12"),
        (8, ""),
        (9, "word,- and more"),
        (10, "ЧА)9Ь 1"),
        (11, "M8/ 15-г/ п79;с8/:)J98 к4/б7"),
        (12, "see http://x.example/a1 for more"),
        (13, None),
        (14, "a1b plain words that go on for long enough to pass the limit of eighty letters in a row here"),
        (15, "x(y and z)w twice"),
    ],
)
HEADINGS: Rows = (
    "id int, text string, size double",
    [
        (1, "Глава 1. Начало", 12.0),
        (2, "Chapter one", 12.0),
        (3, "Chapter one ends.", 12.0),
        (4, "УДК 159.9", 24.0),
        (5, "Б 79", 24.0),
        (6, "ISBN 5-17-0", 24.0),
        (7, "A plain heading", 24.0),
        (8, "A lesser heading", 18.0),
        (9, "A small heading", 15.0),
        (10, "text", 11.5),
        (11, "x" * 81, 24.0),
        (12, "Гла)а 1. ,)еде-ие", 24.0),
    ],
)
JOBS: Rows = (
    "job_id int, status string, progress int, name string, file_hash string, layout string, path string, error string, fixed_key string, slot_key string",
    [
        (1, "done", 100, "a.pdf", "h1", "flow", "/x/a", None, None, "s1"),
        (2, "processing", 40, "b.pdf", "h2", "flow", "/x/b", None, "e2", "s2"),
        (3, "queued", 0, "c.v2.pdf", "h2", "keep", "/x/c", None, "", "s3"),
        (4, "error", 10, "d", "h4", "flow", "/x/d", "GET /v1?key=abc123&m=2 failed", None, None),
        (5, "cancelling", 70, "e.pdf", "h5", "flow", "/x/e", None, "e5", None),
        (6, "queued", 0, "f.pdf", "h2", "flow", "/x/f", "key=zz", " ", "s6"),
    ],
)
SUBMITS: Rows = ("submit int, file_hash string, layout string", [(1, "h1", "flow"), (2, "h2", "flow"), (3, "h2", "keep"), (4, "h5", "flow"), (5, "h9", "flow")])
COLOURS: Rows = (
    "id int, colour int, hex string, flags int, size double",
    [(1, 0, "#000", 0, 10.0), (2, 16777215, "#FFFFFF", 2, 10.0), (3, 8388736, "800080", 4, 15.0), (4, 1193046, "12zz34", 16, 11.0), (5, 255, " #00f ", 22, 9.0), (6, 65280, None, 18, 14.0)],
)
SPANS: Rows = (
    "block int, ord int, kind int, text string, size double",
    [(1, 0, 0, "small", 9.0), (1, 1, 0, "large one", 14.0), (1, 2, 0, "large two", 14.0), (2, 0, 0, " ", 30.0), (2, 1, 0, "only", 8.0), (3, 0, 1, "image", 50.0), (4, 0, 0, "при-\nмер\nтут ", 10.0), (5, 0, 0, "", 1.0)],
)
GLOSSARY: Rows = ("ord int, term string, value string", [(0, "Meta", "Мета"), (1, "meta", "мета2"), (2, "NLP", "НЛП"), (3, "x", "short"), (4, "garb,-le", "v"), (5, "Anchor", ""), (6, "Anchor", "якорь"), (7, "State", "ста,-н")])
PINS: Rows = ("term string", [("NLP",), ("DNA",)])
MASK: Rows = ("block int, y int, v boolean", [(b, y, (y * (3 + b)) % 11 in (1, 2, 3, 4, 5) or (y % 17 == 0)) for b in (0, 1, 2) for y in range(60)])
FLOW: Rows = (
    "book string, page int, par_no int, kind string, text string, y0 double",
    [
        ("literal", 1, 0, "h1", "Глава первая", 30.0),
        ("literal", 1, 1, "para", "Абзац идёт через стра-", 44.0),
        ("literal", 2, 0, "para", "ницу и дальше", 30.0),
        ("literal", 2, 1, "para", "на той же странице", 44.0),
        ("literal", 3, 0, "para", "и ещё на одной.", 30.0),
        ("literal", 3, 1, "para", "строка после точки", 44.0),
        ("literal", 4, 0, "para", "Новая с большой", 30.0),
        ("literal", 5, 0, "h2", "Заголовок", 30.0),
        ("literal", 5, 1, "para", "goes on after a heading", 44.0),
        ("literal", 6, 0, "para", "and over the page", 30.0),
        ("literal", 7, 0, "para", "and over another one", 30.0),
    ],
)
INK_BOXES: Rows = ("block int, x0 int, y0 int, x1 int, y1 int", [(0, 8, 5, 28, 50), (1, 10, 20, 14, 24), (2, 6, 0, 30, 3), (3, 1, 1, 2, 2)])
#: Between texts that are sent together.
DELIMITER = "\n@@@\n"
PIXELS: Rows = ("id int, r int, g int, b int, n int", [(1, 13, 20, 30, 4), (1, 14, 21, 31, 3), (1, 200, 200, 250, 6), (2, 255, 255, 255, 2), (2, 0, 5, 11, 2), (3, 100, 100, 100, 1), (3, 107, 100, 100, 1)])
COVERS: Rows = (
    "id int, raw string",
    [
        (1, 'Sure: ```json\n[{"text": "Title", "bbox_pct": [10, 5, 95, 20], "color": "#fff", "role": "TITLE"}, {"text": "x", "bbox_pct": [0, 0, 1, 1]}]\n```'),
        (2, '[{"text": "Pixels", "bbox_pct": [400, 300, 200, 150], "role": "logo"}]'),
        (3, "no array"),
        (4, '[{"text": "Bad box", "bbox_pct": [10, 5, 0, 20]}]'),
        (5, '[{"text": "Author Name", "bbox_pct": [50, 90, 60, 30], "color": "102030", "role": "author"}]'),
    ],
)
#: Pages before the given ones: originals stay in books whose first id is divisible by 5.
COVER_PAGES: Rows = (
    "book string, doc_id int, text string",
    [
        ("literal picture", -14, " \n\t\r\n"),
        ("literal picture", -13, "Title"),
        ("literal null", -12, None),
        ("literal empty", -11, ""),
        ("literal kept", -10, "\n"),
        ("literal kept", -9, " "),
        ("literal letter", -8, "\nx"),
        ("literal later", -7, "Title"),
        ("literal later", -6, "\n"),
    ],
)
TOC: Rows = (
    "book string, page int, line_no int, text string",
    [("b", 0, 0, "Con"), ("b", 0, 1, "tents"), ("b", 0, 2, "x"), ("b", 1, 0, "One .... 12"), ("b", 1, 1, "Two … … 3"), ("b", 1, 2, "Three..... 14"), ("b", 1, 3, "Four…… 25"), ("b", 2, 0, "Prose."), ("b", 2, 1, "One .... 12"), ("b", 3, 0, "ЗМІСТ")],
)


def frame(spark: SparkSession, rows: Rows) -> DataFrame:
    return spark.createDataFrame(rows[1], rows[0])


def values(rows: Rows) -> str:
    """The table as a parenthesised SELECT of typed values."""
    types = {"int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    fields = [f.split(" ") for f in rows[0].split(", ")]

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v) if not isinstance(v, bool) else str(v).upper()

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows[1])
    return f"(SELECT {', '.join(f'CAST({n} AS {types[t]}) AS {n}' for n, t in fields)} FROM (VALUES {body}) v({', '.join(n for n, _ in fields)}))"
