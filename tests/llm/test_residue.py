import pytest

from polyad.llm.residue import residue, without_residue

SCHEMA = "doc_id long, text string, source string, slot string"
REAL = "We asked forty nursing students how camera use changed. The panel joined costs to the merits by order no. 36. Workload rose sharply once classes moved online and fell again in spring. "
CASES = [
    "Dear {{ name }}, your record ${code} was filed on 2 June 2001.", REAL + "This note was written by [TBD] for project __PROJECT__.", "Title: undefined", "Sehr geehrte Frau NaN, die Sache %(x)s ist abgeschlossen.",
    "404 Not Found\nMenu  Login  Contact", "Our sample was small, and the wei [...]\nAccess denied\nYou do not have permission to open this record.", "Traceback (most recent call last):\n  File \"serve.py\", line 3, in show\nKeyError: 'doc'",
    '{"error": {"code": 502, "message": "quota exceeded"}}', "Please enable JavaScript to view this page.", "Ihr Browser wird nicht unterstützt. Bitte erlauben Sie Cookies und aktive Inhalte.", "Lorem ipsum dolur dapis maurin. Quisqua augus dolur adipo vivam tortis sodalo.",
    "Sample text. Sample text. Sample text.", "La página\nPágina no encontrada", "YOUR SESSION HAS EXPIRED. SIGN IN AGAIN TO CONTINUE.", "Año: `r start`", "Aktenzeichen: `r a`, Senat: `r b`.",
]
# Messages written for this test; the rules know their words and shapes, not these sentences.
UNSEEN = [
    "The requested URL was not found on this server.", "Diese Seite benötigt JavaScript.", "Este sitio requiere JavaScript.", "Dear <First Name>, thank you for your order.", "Dear %%FNAME%%, see you on Monday.", "[Placeholder text]",
    "Hello *|FNAME|*, your parcel has left our house.", "We're sorry, an unexpected error has occurred. Please try again later.", "502 Bad Gateway", "Cette page est introuvable.", "Ce site nécessite JavaScript pour fonctionner.", "El servicio no está disponible en este momento.",
    "Die angeforderte Ressource ist nicht verfügbar.", "You need to allow cookies to use this site.", "This site works best with scripts enabled. Please turn on JavaScript.", "java.lang.NullPointerException: null\n  at com.example.Main.run(Main.java:7)", "Dolor sit amet consectetur adipiscing elit. Vestibulum quis fermentum nulla dapibus.",
    "test test test test test test test", "qwer asdf zxcv asdf", "xxxx xxx xxxxx xx xxxxxxx", "Replace this text with your own content.", "Site under maintenance. We will be back soon.", "Error: connection timed out", "Für diese Seite muss JavaScript erlaubt sein.",
]
REAL_ONES = [
    REAL, REAL + 'We removed 30 records that said "please try again later" or "your browser is not supported".', "In a report template, `{{ name }}` stands for the name and is replaced when the page is built.", "Escape it as \\{% x %} if you want to print {% x %} itself.",
    "Students had to enable JavaScript and cookies on school laptops, which cost teachers 4 minutes per class.", "Access denied to counsel for 5 days was, in the view of the panel, no denial of justice.", "La page introuvable du dossier fut versée le 3 mars 2001.",
    "The sample text in chapter 9 has 47 words and was read aloud by tutors.", "Let $A = B B^T$ and $\\frac{d_i}{\\sum_{j} d_j}$ be the degrees; the set {a, b, c} is one edge.", 'msg <- glue("{n} edges in {k} groups")', "Rows with a missing walk raise an error.",
    "A mean over no rows is NaN, and an undefined ratio is shown as NA.", "Names are masked in the transcripts: [Speaker 3] asks, [Speaker 4] answers.", "The maxim pacta sunt servanda, the panel wrote, and rebus sic stantibus do not exclude each other.",
    "An internal error of the registry on 10 May 1979 delayed service, and the time limit was extended.", "The court found that no road was closed by the storm and that the farmers had no other way to the market.", "", "  \n ", None,
]


@pytest.mark.parametrize(("texts", "case"), [(CASES, True), (UNSEEN, True), (REAL_ONES, False)])
def test_known_texts(spark, texts, case):
    df = spark.createDataFrame([(i, t, f"h{i}", "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"] for r in residue(df).collect()}
    assert [texts[i] for i in range(len(texts)) if (i in got) != case] == []


def test_recurrent_lines_of_a_host_do_not_count(spark):
    chrome = "\n".join(f"Sector {w} and its long list" for w in ("fisheries", "railways", "cement", "solar parks", "water supply", "toll roads"))
    rows = [(i, REAL + "\n" + chrome, "Site ", "") for i in range(20)] + [(99, chrome + "\nService Unavailable", "site", ""), (98, chrome.replace("Sector", "Region") + "\nService Unavailable", None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in residue(df).collect()} == {99}
    assert without_residue(df).count() == 21


@pytest.mark.parametrize("line", ["Please enable JavaScript to view this page.", "Version [TBD] of this site", "This site uses cookies and needs scripts; by reading on you allow cookies, and you can switch them off later in the settings of your browser at any time."])
def test_boilerplate_with_signs_goes_first(spark, line):
    """Footers of a host, of any length, are subtracted before evidence is taken; the same line alone is the page."""
    words = "amber birch cedar delta ember fjord grove heath inlet knoll larch marsh north".split()
    rows = [(i, "Report on the " + " ".join(words[(i // 13**k + k) % 13] for k in range(10)) + f" of {words[(i * i) % 13]}\n{line}", "site", "") for i in range(200)]
    assert residue(spark.createDataFrame(rows, SCHEMA)).count() == 0
    if "[" not in line:
        alone = [(1000 + i, line, "blocked", "") for i in range(30)]
        assert {r["doc_id"] for r in residue(spark.createDataFrame(rows + alone, SCHEMA)).collect()} == {r[0] for r in alone}


def test_repeated_rows_long_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "Title: [TBD]", None, ""), (1, "Title: [TBD]", None, ""), (2, REAL * 3000, "h", ""), (3, REAL * 3000 + "We found {title} hyperedges.", "h", "")], SCHEMA)
    assert sorted(r["doc_id"] for r in residue(df).collect()) == [1, 1, 3]
    assert residue(df.limit(0)).count() == 0
