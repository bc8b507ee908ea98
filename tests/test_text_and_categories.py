import pytest
from pyspark.sql import functions as F

from cratewise.functions import category as C
from cratewise.functions import present as P
from cratewise.functions import text as T
from cratewise.functions import variant as V


def column(spark, values, expression):
    """The expression over one text column ``v``, in the order of the values."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


NAMES = {
    "a-1.2": ("a", "1.2"),
    "a-b-1.2": ("a-b", "1.2"),
    "a": ("a", "unknown"),
    "a-b": ("a", "b"),
    "vim-9.0": ("vim-9.0", "vim-9.0"),
    "python-vlc-3": ("python", "vlc-3"),
    "": ("unknown", "unknown"),
    None: ("unknown", "unknown"),
    "-1.0": ("-1.0", "1.0"),
    "-1.0-2": ("-1.0-2", "1.0-2"),
    "--1": ("-", "1"),
    "abc-": ("abc", ""),
    "-abc": ("", "abc"),
    "7zip-x": ("7zip-x", "7zip-x"),
    "x-²": ("x", "²"),
}


def test_names_and_versions(spark):
    names = list(NAMES)
    assert column(spark, names, T.package_name(F.col("v"))) == [NAMES[n][0] for n in names]
    assert column(spark, names, T.package_version(F.col("v"))) == [NAMES[n][1] for n in names]


def test_package_id(spark):
    cases = {
        "pkgs.a.x86_64-linux": "pkgs.a",
        "pkgs.a.aarch64-darwin": "pkgs.a",
        "pkgs.linuxPackages": "pkgs",
        "linux": "linux",
        " pkgs.b ": "pkgs.b",
        "": "n@1",
    }
    got = column(spark, list(cases), T.package_id(F.col("v"), F.lit("n"), F.lit("1")))
    assert got == list(cases.values())
    assert column(spark, [""], T.package_id(F.col("v"), F.lit(""), F.lit(" "))) == ["unknown"]


def test_small_text_rules(spark):
    assert column(spark, ["a.b", "a", ""], T.system_of(F.col("v"))) == ["b", "", ""]
    paths = ["/s/hash-foo-1.2", "/s/plain", "/s/h-vim-9/"]
    assert column(spark, paths, T.name_from_store_path(F.col("v"))) == ["foo", None, "vim-9"]
    assert column(spark, [" \x1c a\u0000b \n"], T.clean_text(F.col("v"))) == ["ab"]
    assert column(spark, [" " + "x" * 3000], F.length(T.clean_text(F.col("v")))) == [3000]
    assert column(spark, [" " + "x" * 3000], F.length(T.clean_text(F.col("v"), 2000))) == [2000]
    assert column(spark, ["aaaa bbbb", "a b c d", ""], T.token_estimate(F.col("v"))) == [2, 4, 0]
    assert column(spark, ["nixpkgs.a.b", "other.a"], T.display_name(F.col("v"))) == ["a.b", "other.a"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("C++/C# Élan_vital", ["c", "c", "elan", "vital"]),
        ("été x86-64", ["ete", "x86", "64"]),
        ("Привет, 世界!", ["привет", "世界"]),
        (" ?! ", []),
    ],
)
def test_tokens(spark, text, tokens):
    assert T.tokens_of(spark, text) == tokens


def test_categories(spark):
    paths = ["python3Packages.vim", "pkgs.vim", "haskell.packages.x", "haskellXpackages", "a.clip", "zzz", "perl.x"]
    lowered = spark.createDataFrame(list(enumerate(paths)), "i int, v string").withColumn("p", F.lower("v"))
    got = [r[0] for r in lowered.orderBy("i").select(C.category_of_path("p")).collect()]
    assert got == ["python", "editors", "haskell", "misc", "tools", "misc", "perl"]
    names = ["Applications.Editors", "Tools.Text", "Weird.One", ""]
    assert column(spark, names, C.category_name(F.col("v"))) == ["editors", "text-tools", "weird.one", "misc"]


def test_license_presentation(spark):
    texts = ['{"shortName":"mit","free":true}', '{"fullName":"x"}', "null", "{bad", '{"shortName":""}']
    assert column(spark, texts, P.license_display(F.col("v"))) == ["mit", "Unknown", "Unknown", "Unknown", "Unknown"]
    assert column(spark, texts, P.is_free(F.col("v"))) == [True, False, False, False, False]
    assert column(spark, texts[:4], P.license_list(F.col("v"))) == [["mit"], [None], ["Unknown"], ["Unknown"]]
    family = P.license_family(F.split("v", ","))
    assert column(spark, ["LGPL,MIT", "GPL-3", "Apache-2", "Zlib", None], family) == [
        "permissive", "copyleft", "apache", "other", "other"
    ]


REQUESTS = [
    ({}, ("", 50, 0, None, None, False, False)),
    ({"q": "x", "limit": "invalid", "offset": "not_a_number"}, ("x", 50, 0, None, None, False, False)),
    ({"limit": "-5", "offset": "-10"}, ("", -5, -10, None, None, False, False)),
    ({"limit": "0", "offset": "50"}, ("", 0, 50, None, None, False, False)),
    ({"limit": "99999999999", "offset": "+5"}, ("", 50, 5, None, None, False, False)),
    (
        {"q": "c++/c# programming", "license": "GPL-2.0+", "category": "devel/libs", "include_broken": "YES", "include_unfree": "on"},
        ("c++/c# programming", 50, 0, "GPL-2.0+", "devel/libs", True, False),
    ),
]


def test_request_parameters(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(REQUESTS)], "i int, params map<string,string>")
    typed = rows.orderBy("i").select(*[c.alias(n) for n, c in P.request_columns(F.col("params")).items()])
    assert [tuple(r) for r in typed.collect()] == [want for _, want in REQUESTS]


def test_result_json_leaves_out_null_optionals(spark):
    row = spark.sql("SELECT 'p' AS package_id, 1.0D AS relevance_score, CAST(NULL AS STRING) AS position, array('a') AS platforms")
    assert row.select(P.result_json(row.columns)).first()[0] == '{"packageId":"p","relevanceScore":1.0,"platforms":["a"]}'


def test_lists_are_whole_unless_a_cap_is_asked_for(spark):
    people = '{"p": [' + ",".join(f'"x{i}"' for i in range(30)) + "]}"
    listed = spark.createDataFrame([(people,)], "j string").select(V.field(F.parse_json("j"), "p").alias("p")).select("p", V.kind(F.col("p")).alias("k"))
    value, k = F.col("p"), F.col("k")
    row = listed.select(
        F.size(V.platforms(value, k)).alias("a"), F.size(V.platforms(value, k, 20)).alias("b"),
        F.size(V.maintainers(value, k)).alias("c"), F.size(V.maintainers(value, k, 10)).alias("d"),
    ).first()
    assert tuple(row) == (30, 20, 30, 10)


def test_package_id_needs_no_pattern(spark):
    paths = [None, "", ".", "a", ".linux", "a.linux", "linux", "a.b", "a.b-linux ", " a.darwin.x", "a.\nwindows\n", "é.ü-linux", "a..linux", "linux.a", "a.linux."]
    whole = ["unknown", "unknown", ".", "a", "", "a", "linux", "a.b", "a", "a.darwin.x", "a", "é", "a.", "linux.a", "a.linux."]
    frame = spark.createDataFrame([(p,) for p in paths], "p string").select(T.package_id(F.col("p"), F.lit(""), F.lit("")).alias("id"))
    assert [r["id"] for r in frame.collect()] == whole
    assert "regexp" not in frame._jdf.queryExecution().analyzed().toString()
