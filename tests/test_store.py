import io
import json
import random
import socket
import threading
import urllib.error
import urllib.request
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirefold import server
from quirefold.api import Corpus
from quirefold.cli import help_on, main
from quirefold.operators.store import DocumentStore, DuplicatePathError, merge, newest
from quirefold.schema import DOC_SCHEMA
from quirefold.shell import Shell
from quirefold.sinks import outputs
from quirefold.streaming.upsert import watch

T = datetime(2024, 1, 1)


def doc(i, path, title, ft, tags=None):
    return (i, path, title, None, ft, None, None, None, tags, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA)


def model(old, new):
    """merge() in plain Python, by path."""
    out = {}
    for p, n in new.items():
        o = old.get(p)
        if o is None:
            out[p] = n
        else:
            later = n[4] is not None and o[4] is not None and n[4] > o[4]
            equal = n[4] is not None and n[4] == o[4]
            scalars = n if later else o
            out[p] = (o[0], p, *scalars[2:7], *(n if later or equal else o)[7:])
    return out


def test_merge_equals_a_dictionary(spark):
    rng = random.Random(3)

    def some():
        return {p: doc(i, p, rng.choice([None, "a", "b"]), rng.choice([None, T, T + timedelta(1), T + timedelta(2)]), rng.choice([None, [], ["x"], ["y", "z"]])) for i, p in enumerate(rng.sample("abcdefghijklmnop", 12))}

    for _ in range(4):
        old, new = some(), some()
        got = {r.path: tuple(r) for r in merge(frame(spark, list(old.values())), frame(spark, list(new.values()))).collect()}
        assert got == model(old, new)


def test_store_puts_updates_and_tidies(spark, tmp_path):
    s = DocumentStore(spark, f"file://{tmp_path}/s")
    assert s.read().collect() == []
    s.put(frame(spark, [doc(1, "a", "A", T, ["x"]), doc(2, "b", "B", T, ["y"])]))
    with pytest.raises(DuplicatePathError):
        s.put(frame(spark, [doc(9, "a", "Z", T)]))
    with pytest.raises(DuplicatePathError):
        s.put(frame(spark, [doc(9, "z", "Z", T), doc(10, "z", "Z", T)]))
    assert len(list((tmp_path / "s").glob("data-*"))) == 1  # what was refused is gone
    s.update(frame(spark, [doc(7, "a", "A2", T + timedelta(1), []), doc(8, "c", "C", None)]))
    assert sorted((r.doc_id, r.path, r.title, r.tags) for r in s.read().collect()) == [(1, "a", "A2", []), (8, "c", "C", None)]
    assert sorted(r.path for r in s.read(0).collect()) == ["a", "b"]
    s.update_some(frame(spark, [doc(3, "d", "D", T, ["n"])]))
    s.tidy(1)
    assert s.info()["files"] == 1 and s.info()["last_update"] == "tidy" and s.info()["version"] == 3
    assert [r.tag for r in s.tags().collect()] == ["n"] and s.authors().collect() == []


def test_newest_and_stream(spark, tmp_path):
    rows = [doc(1, "a", "old", T), doc(1, "a", "new", T + timedelta(1)), doc(2, "b", None, None), doc(2, "b", "x", None)]
    assert sorted((r.path, r.title) for r in newest(frame(spark, rows)).collect()) == [("a", "new"), ("b", "x")]
    s = DocumentStore(spark, f"file://{tmp_path}/s")
    (tmp_path / "in").mkdir()
    for k, part in enumerate(([rows[0]], [rows[1], rows[3]], [doc(1, "a", "late", T)])):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        watch(spark, str(tmp_path / "in"), s, str(tmp_path / "check")).awaitTermination(120)
        assert s.info()["batch"] == k
    assert sorted((r.path, r.title) for r in s.read().collect()) == [("a", "new"), ("b", "x")]


def test_changes_write_what_changes_and_no_writer_is_lost(spark, tmp_path):
    s = DocumentStore(spark, f"file://{tmp_path}/s")
    s.put(frame(spark, [doc(i, f"p{i}", "old", T) for i in range(200)]))
    before = set(s.table.latest().files)
    s.update_some(frame(spark, [doc(900, "p3", "new", T + timedelta(1)), doc(901, "p4", "late", T - timedelta(1)), doc(902, "q", "Q", T)]))
    added = set(s.table.latest().files) - before
    assert before <= set(s.table.latest().files) and sum(spark.read.parquet(f"{s.table.root}/{f}").count() for f in added) == 2
    rows = {r.path: (r.doc_id, r.title) for r in s.read().collect()}
    assert len(rows) == 201 == s.read().count() and (rows["p3"], rows["p4"], rows["q"]) == ((3, "new"), (4, "old"), (902, "Q"))
    # A put between the reading and the commit of an update.
    commit, other = s.table.commit, DocumentStore(spark, s.table.root)

    def late(*args, **kwargs):
        s.table.commit = commit
        other.put(frame(spark, [doc(903, "r", "R", T)]))
        return commit(*args, **kwargs)

    s.table.commit = late
    s.update_some(frame(spark, [doc(904, "q", "Q2", T + timedelta(1))]))
    rows = {r.path: r.title for r in s.read().collect()}
    assert rows["r"] == "R" and rows["q"] == "Q2" and len(rows) == 202
    # Two puts of one path.
    s.table.commit = lambda *a, **k: (setattr(s.table, "commit", commit), other.put(frame(spark, [doc(905, "z", "1", T)])), commit(*a, **k))[2]
    with pytest.raises(DuplicatePathError):
        s.put(frame(spark, [doc(906, "z", "2", T)]))
    s.update(frame(spark, [doc(907, "z", "3", T + timedelta(1))]))
    assert [(r.doc_id, r.title) for r in s.read().collect()] == [(905, "3")]
    files = lambda: sum(1 for _ in (tmp_path / "s").glob("data-*/*.parquet"))
    had = files()
    s.tidy(1, keep=1, grace=-5)
    assert files() == 1 < had and s.read().count() == 1 and not s.table.latest().deletes


# -- output ------------------------------------------------------------------------------------------------------------
ONE = (1, "p/a.md", 'T "q"', datetime(2024, 3, 5, 6, 7, 8), None, "# H\n", None, ["A", "B"], ["x"], None)


def test_outputs(spark):
    df = frame(spark, [ONE])
    text = lambda *a, **k: "".join(outputs.stream(df, *a, **k))
    assert text() == 'p/a.md T "q" 2024-03-05 06:07:08 +0000 UTC authors:A,B tags:x\n'
    assert text("pathonly") == "p/a.md\n"
    assert text("custom", "|", pattern="%p%%%T %d %f [%a] %t %h%l%m", list_separator=";") == 'p/a.md%T "q" 2024-03-05T06:07:08Z 0001-01-01T00:00:00Z [A;B] x # H\n|'
    j = json.loads(text("json"))
    assert list(j[0]) == list(outputs.FIELDS) and j[0]["links"] is None and j[0]["meta"] == "" and j[0]["filetime"] == "0001-01-01T00:00:00Z"
    import yaml

    y = yaml.safe_load(text("yaml"))
    assert y[0]["title"] == 'T "q"' and y[0]["authors"] == ["A", "B"] and list(y[0]) == list(outputs.FIELDS)
    nothing = df.limit(0)
    assert "".join(outputs.stream(nothing, "json")) == "[]" and "".join(outputs.stream(nothing, "yaml")) == "[]\n" and "".join(outputs.stream(nothing)) == ""


def test_formats(spark, tmp_path):
    assert outputs.parse_format("a%p%%b") == [("text", "a"), ("field", "path"), ("text", "%"), ("text", "b")]
    for bad in ("%x", "a%"):
        with pytest.raises(outputs.FormatError):
            outputs.parse_format(bad)
    with pytest.raises(outputs.FormatError):
        outputs.render(frame(spark, [ONE]), "xml")
    outputs.write_text(frame(spark, [ONE]), str(tmp_path / "o"), "pathonly", "|")
    assert "p/a.md|" in [p.read_text() for p in (tmp_path / "o").glob("part*")]


# -- shell, command line, servers ----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(frame(spark, [doc(1, "a.md", "Alpha", T, ["x"]), doc(2, "b.md", "Beta", T + timedelta(1), ["y"]), doc(3, "c.md", None, None)]).cache())


def test_shell(corpus):
    out = io.StringIO()
    s = Shell(corpus, out, {"db": "here"})
    s.run(io.StringIO("""# a comment

+ 1 * 2 3
/ -7 2
let q `t=x
let c parse tokenize q
print c
len c
len tokenize q
at 0 c
opt compact,sort c
optimize 0 c
compile c
execute compile c
query t=y
query `T=Nothing
let s `abcdef
slice s 1 3
len query T/a
at 0 query T/a
env
repattern
rematch `a:b
tokenise `x
opt compcat c
print qq
/ 1 0
slice s 0 9
1 2
del q
print q
help
exit
+ 1 1
"""))
    text = out.getvalue()
    for part in ("7\n", "-3\n", '(and\n  tags="x"\n)', "tags IN ('x')", "a.md Alpha 0001", "b.md Beta", "No results.", "bc\n", "2\n", "db = here", "did you mean 'tokenize'", "did you mean 'compact'",
                 "did you mean 'q'", "division by zero", "bounds out of range", "too much", "no variable 'q'", "tokenize <text>"):
        assert part in text, part
    deep = Shell(None, out)
    with pytest.raises(ValueError, match="deeply"):
        deep.line("+ " * 300 + "1")


def test_command_line(spark, tmp_path):
    notes = tmp_path / "notes"
    (notes / "sub").mkdir(parents=True)
    (notes / "a.md").write_text("---\ntitle: Alpha\ntags: [x, y]\nauthor: Ann\ndate: 2024-01-02\n---\n# Head\n[l](b.md)\n")
    (notes / "sub" / "b.md").write_text("---\ntitle: Beta\ntags: [y]\n---\n")
    (notes / "bad.md").write_text("---\ntags: [x\n---\n")

    def run(*args):
        out = io.StringIO()
        code = main(["--root", str(notes), "--db", str(tmp_path / "db"), "--logFile", str(tmp_path / "log"), *args], spark, out)
        return code, out.getvalue()

    assert run("index", "build") == (0, "2 documents, 1 errors\n")
    assert run("index", "build")[0] == 1
    assert run("query", "t=y", "--sortBy", "title", "--sortDesc", "--outFormat", "pathonly") == (0, "sub/b.md\na.md\n")
    assert run("q", "--outFormat", "custom", "--outCustomFormat", "%T:%t", "--listSeparator", "+", "--docSeparator", "|", "a=Ann") == (0, "Alpha:x+y|")
    assert json.loads(run("q", "l=b.md", "--outFormat", "json")[1])[0]["headings"] == "# Head\n"
    assert run("q", "T=None") == (0, "No results.\n")
    assert run("q", "nonsense") [0] == 2
    (notes / "sub" / "b.md").unlink()
    assert run("index", "update", )[1] == "1 documents, 1 errors\n"
    assert run("q", "t=y", "--outFormat", "pathonly") == (0, "a.md\n")
    assert run("index", "tidy")[0] == 0
    assert run("completions")[0] == 0 and "bad.md" in (tmp_path / "log").read_text()
    out = io.StringIO()
    assert help_on("qery", out) == 1 and "query" in out.getvalue()
    assert all(help_on(t, out) == 0 for t in ("", "query", "index build", "shell", "language", "filters", "server"))


def test_http(corpus):
    http = server.serve_http(corpus, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}"

    def post(path, body, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(url + path, body.encode(), headers, method="POST")) as r:
                return r.status, r.read().decode(), dict(r.headers)
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(), dict(e.headers)

    status, body, headers = post("/search?sortBy=title&sortOrder=desc", "T/a")
    assert status == 200 and [d["path"] for d in json.loads(body)] == ["b.md", "a.md"]
    assert headers["Last-Modified"] == "Tue, 02 Jan 2024 00:00:00 GMT"
    assert [d["path"] for d in json.loads(post("/search", "query=t%3Dx")[1])] == ["a.md"]
    assert post("/search", "T=Nothing")[:2] == (200, "[]")
    assert post("/search", "what")[0] == 400 and post("/other", "")[0] == 404
    assert post("/search", "T/a", **{"If-Modified-Since": "Wed, 03 Jan 2024 00:00:00 GMT"})[0] == 304
    http.shutdown()


def test_a_server_asks_the_latest_version_and_drains(spark, tmp_path):
    kept = DocumentStore(spark, f"file://{tmp_path}/s")
    kept.put(frame(spark, [doc(1, "a", "A", T)]))
    http = server.serve_http(lambda: Corpus(kept.read()), port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    ask = lambda: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/search", data=b"p/^.", timeout=120).read())
    assert [r["path"] for r in ask()] == ["a"]
    kept.update_some(frame(spark, [doc(2, "b", "B", T)]))
    assert sorted(r["path"] for r in ask()) == ["a", "b"]
    late = threading.Thread(target=ask)
    late.start()
    while not http._working:
        pass
    http.shutdown()
    assert http.drain(60) and not http._working
    late.join()
    assert http.drain(0)


def test_forms_of_ones_own(spark):
    df = frame(spark, [ONE])
    assert outputs.render(df, lambda: F.upper("path")).first().text == "P/A.MD"
    assert outputs.render(df, outputs.from_function(lambda d: f"{d['path']}|{d['authors'][1]}|{d['meta']}")).first().text == "p/a.md|B|None"
    outputs.register("mark", lambda mark="-": F.concat(F.lit(mark), "path"))
    try:
        assert "".join(outputs.stream(df, "mark", mark="+")) == "+p/a.md\n"
    finally:
        del outputs.FORMS["mark"]


def test_unix_socket(corpus, tmp_path):
    def ask(timeout, *messages):
        path = str(tmp_path / f"s{timeout}")
        u = server.serve_unix(corpus, path, timeout)
        threading.Thread(target=u.serve_forever, daemon=True).start()
        with socket.socket(socket.AF_UNIX) as c:
            c.connect(path)
            got = b""
            for m in messages:
                c.sendall(m)
            while got.count(b"\x04") < len(messages) and (part := c.recv(4096)):
                got += part
        u.shutdown()
        return got

    line = b"a.md Alpha 0001-01-01 00:00:00 +0000 UTC authors: tags:x\n"
    assert ask(None, b"t=x\x05", b"T=Nothing\x05") == b"\x01Num Docs: 1\x02" + line + b"\x03\x04" + b"\x01Num Docs: 0\x02\x03\x04"
    assert ask(60.0, b"what\x05") == b"\x01Error handling query\x02\x03query compilation error\x04"
    stop = server.every(0.01, lambda: None)
    stop.set()
