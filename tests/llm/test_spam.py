import random

from codeloam.llm.spam import spam_pages, weigh

R = random.Random(4)
NOUNS = "cable lamp garden window boiler fence carpet tiles".split()
PROSE = "We moved the boiler to the other room because the pipe was too short for it. After that the window could be opened again without any trouble. Nobody knows why the first owner had put it there. "

PAGES = {
    "keywords": (" | ".join(R.choice(["cheap red lamp", "buy garden fence", "best carpet tiles online"]) for _ in range(60)), True),
    "lines": ("\n".join(R.choice(["cheap red lamp", "buy garden fence free"]) for _ in range(60)), True),
    "stuffed": (" ".join(R.choice(["Buy cheap red lamp and get more cheap red lamp today.", "Our cheap red lamp is the best cheap red lamp of all."]) for _ in range(30)), True),
    "links": ("\n".join(f'<a href="https://x{i}.example/{R.choice(NOUNS)}">{R.choice(NOUNS)} {R.choice(NOUNS)}</a>' for i in range(30)), True),
    "entries": ("\n".join(f"red {R.choice(NOUNS)}: https://x{i}.example/p" for i in range(30)), True),
    "trails": ("\n".join(f"{R.choice(NOUNS)} > {R.choice(NOUNS)} > {R.choice(NOUNS)} ({i})" for i in range(40)), True),
    "tags": ("Tags: " + ", ".join(f"{R.choice(NOUNS)}-{R.choice(NOUNS)}" for _ in range(80)), True),
    "hashtags": ("\n".join(f"#{R.choice(NOUNS)}sale #{R.choice(NOUNS)} now {i}.99" for i in range(40)), True),
    "framed": (PROSE + "\n\n" + ", ".join(R.choice(["cheap red lamp", "garden fence plugin"]) for _ in range(200)) + "\n\n" + PROSE, True),
    "prose": (PROSE * 8, False),
    "prose with tags": (PROSE * 8 + "\n\nTags: lamp, garden, fence, boiler", False),
    "log": ("\n".join(f"2024-01-02 03:04:{i:02d} ERROR boiler.start: the pipe was too short id={i}" for i in range(60)), False),
    "code": ("```\n" + "\n".join(f"let {R.choice(NOUNS)} = open({i});" for i in range(60)) + "\n```\n" + PROSE, False),
    "bare code": ("\n".join(f"let {R.choice(NOUNS)} = open({i});" for i in range(60)), False),
    "changelog": ("# Changelog\n" + "\n".join(f"- Fix `open_{R.choice(NOUNS)}` (#{i})" for i in range(40)), False),
    "settings": ("| key | default | meaning |\n|---|---|---|\n" + "\n".join(f"| `{R.choice(NOUNS)}` | {i} | How long the {R.choice(NOUNS)} waits for an answer. |" for i in range(30)), False),
    "link guide": ("\n".join(f"- [{R.choice(NOUNS)}](https://x.example/{i}) - Tells how the {R.choice(NOUNS)} is put up in a small room." for i in range(30)), False),
    "glossary": ("\n".join(f"**{R.choice(NOUNS)}**: The part of the {R.choice(NOUNS)} that is seen from the street. The word {R.choice(NOUNS)} is used for it too." for _ in range(30)), False),
    "german": ("Alte Zeilen im Kessel werden nach drei Tagen verworfen. Bitte den Zaun nicht löschen, solange der Garten noch wächst. " * 6, False),
    "bullets": ("\n".join(f"* {R.choice(NOUNS)} {R.choice(NOUNS)}, {R.choice(NOUNS)}" for _ in range(40)), True),
    "block comment": ("/*\n" + "\n".join(f" * {R.choice(NOUNS)} {R.choice(NOUNS)}, {R.choice(NOUNS)}" for _ in range(40)) + "\n */\nint x;", False),
    "polish": ("Stary piec stoi w drugim pokoju, bo rura była za krótka. Potem okno dało się znowu otworzyć bez kłopotu. Nikt nie wie, czemu pierwszy właściciel go tam postawił. " * 3, False),
    "polish keywords": (" | ".join(R.choice(["tania czerwona lampa", "kup płot ogrodowy", "najlepsze płytki"]) for _ in range(60)), True),
    "short": ("red lamp", False), "empty": ("", False),
}


def test_pages(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, (t, _) in PAGES.items()] + [("null", None, ""), (None, PAGES["tags"][0], "")], "doc_id string, text string, spam string")
    got = {r.doc_id: r.spam for r in spam_pages(df).collect()}
    assert got == {**{k: v for k, (_, v) in PAGES.items()}, "null": False, None: True}
    assert spam_pages(df.limit(0)).count() == 0


def test_long_text():
    content, shapes = weigh(PROSE * 20_000)
    assert content > 1_000_000 and not shapes
