from pyspark.sql import functions as F

from codelantern.config import FilterConfig, load_env
from codelantern.functions import text as tx
from codelantern.functions.vectors import cosine
from codelantern.operators.chunking import route_of
from codelantern.operators.filtering import exclusion_reason, in_ignored_directory
from codelantern.sources.repos import parse_repo_url, parse_repo_urls
from tests import model


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("x"))).collect()]


def test_tokens(spark):
    cases = {
        "paginate.hasPreviousPages": ["paginate.haspreviouspages", "paginate", "has", "previous", "pages"],
        "MAX_BUFFER_SIZE handleOAuth2CallbackV2": [
            "max_buffer_size", "handleoauth2callbackv2", "handle", "oauth2", "callback", "v2"],
        "snake_case_name aBcD": ["snake_case_name", "abcd", "bc"],
        "": [],
    }
    odd = ["a\u00a0bc\ufeffde", "\U0001f600 x \U0001f600y é éa", "İstanbul KELVIN \u212a1", "$x _y a$b", "a,b;(cc){dd}[ee]\"ff\"'gg'"]
    values = [*cases, *odd]
    found = column(spark, values, tx.tokenize)
    assert found[: len(cases)] == list(cases.values())
    assert found == [model.tokens(v) for v in values]
    assert column(spark, [None], tx.tokenize) == [[]]


def test_extension_and_language(spark):
    paths = [".gitignore", "a.min.JS", "README", "x/.eslintrc.json", "d.x/file", "a.PY", "b."]
    assert column(spark, paths, tx.extension) == ["", ".js", "", ".json", "", ".py", "."]
    assert column(spark, paths, tx.language_of) == [None, "javascript", None, None, None, "python", None]
    routes = column(spark, ["a.md", "docs/ReadMe", "a.mdx", "a.go", "a.tsx", "LICENSE"], route_of)
    assert routes == ["doc", "doc", "doc", "module", "code", "module"]


def test_file_filter(spark):
    cases = [
        ("src/a.ts", 10, None), ("package-lock.json", 10, "Ignored filename"), ("src/a.min.js", 10, "Minified file"),
        ("logo.PNG", 10, "Ignored extension"), ("big.py", 2097153, "File size exceeds cap (2.0 MB)"),
        ("big.py", 2097152, None), ("LICENSE", 10, None), (".gitignore", 10, "Extension not in allowlist"),
        (".eslintrc.json", 10, None), ("a.py", None, "Unreadable file stats"),
    ]
    rows = spark.createDataFrame([(i, p, s) for i, (p, s, _) in enumerate(cases)], "i int, p string, s bigint")
    found = rows.orderBy("i").select(exclusion_reason(F.col("p"), F.col("s"))).collect()
    assert [r[0] for r in found] == [reason for *_, reason in cases]
    paths = ["docs/guide.md", "a/node_modules/x.js", "Docs/guide.md", "docs", "src/test"]
    assert column(spark, paths, in_ignored_directory) == [True, True, False, False, False]


def test_filter_config_merge():
    assert FilterConfig.merged(ignored_directories=[], max_file_size_bytes=None).ignored_directories == ()
    assert FilterConfig.merged(max_file_size_bytes=0).max_file_size_bytes == 0
    assert FilterConfig.merged(ignored_filenames=None) == FilterConfig()


def test_repository_addresses(spark):
    cases = {
        "owner/repo": "owner/repo", "https://github.com/owner/repo.git": "owner/repo",
        "https://github.com/owner/repo/": "owner/repo", "https://github.com/owner/repo/tree/main/src": "owner/repo",
        "owner/repo.git/": "owner/repo.git", "https://gitlab.com/o/r": "invalid_host",
        "https://github.com/owner": "invalid_url", "github.com/owner/repo": "invalid_url",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    found = {r.url: r.repo_id if r.status == "ok" else r.status for r in parse_repo_urls(rows).collect()}
    assert found == cases
    for url, want in cases.items():
        try:
            assert parse_repo_url(url).repo_id == want
        except ValueError:
            assert want.startswith("invalid")


def test_cosine_edges(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 0.0], [2.0, 0.0]), (1, [1.0], [1.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [], []), (4, [1.0, 1.0], [-1.0, -1.0])],
        "i int, a array<float>, b array<float>")
    found = [r[0] for r in rows.orderBy("i").select(cosine(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 9) for x in found] == [1.0, 0.0, 0.0, 0.0, -1.0]


def test_env_files(tmp_path):
    (tmp_path / ".env").write_text('A=1\nB="two"\n# C=3\nD=your_key\n')
    (tmp_path / ".env.local").write_text("A=9\nD=real\n")
    env = {"B": "kept"}
    load_env(tmp_path, env)
    assert env == {"A": "1", "B": "kept", "D": "real"}
