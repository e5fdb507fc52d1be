import gzip
import json
import time
import zipfile

import pytest

from veilwork import cli
from veilwork.functions import strategies
from veilwork.functions.stream import TAG, Profile
from veilwork.plans import policy
from veilwork.sources import detect, sqldump, sqltext
from veilwork.sources import files as opening

POLICY = """
[rules.users]
email = { strategy = "email", domain = "d" }
[rules.ev]
"payload.p.email" = { strategy = "redact" }
[rules.t]
b = { strategy = "null" }
[row_filters.users]
delete = [{ column = "email", op = "like", value = "drop%" }]
[sensitive_columns]
"public.users" = ["email"]
"""
DUMP = r"""-- start
CREATE TABLE IF NOT EXISTS public.users (id int, email varchar(12), "Nick" character varying(5), CONSTRAINT pk PRIMARY KEY (id));
INSERT INTO "public"."users" (id, "email") VALUES (1, 'a;''b)'), (2, NULL),
 (3, E'it\'s;'), (4, '{"a": 1}'::jsonb), (5, DEFAULT) ON CONFLICT DO NOTHING;
COPY public.users (id, email) FROM stdin;
1	it's;
2	\N
5	drop	x
6	a\tb
\.
select 1; -- ; '
INSERT INTO other VALUES (1, 'x');
INSERT INTO ev (id, payload) VALUES (1, '{"p":{"tier":"gold","email":"a@b.co"}}'::jsonb), (2, '{bad}');
INSERT OR REPLACE INTO [t]([a],[b]) VALUES(1,N'x''y'), (2, 3);
INSERT INTO users (id, email) VALUES (9, 'drop me');
CREATE TABLE other (z int, w varchar);
"""


@pytest.fixture(name="files")
def made_files(tmp_path):
    (tmp_path / "d.sql").write_text(DUMP)
    (tmp_path / "p.toml").write_text(POLICY)
    return tmp_path


def run(spark, files, *more, name="d.sql"):
    code = cli.main(["-i", str(files / name), "-o", str(files / "out.sql"), "-c", str(files / "p.toml"), *more], spark=spark)
    return code, (files / "out.sql").read_text() if (files / "out.sql").exists() else None


def test_segments_cover_the_text():
    raw = DUMP.encode()
    found = list(sqltext.segments(raw.splitlines(True)))
    assert b"".join(raw[s.start : s.end] if s.kind != "copy" else raw[s.body : s.end] for s in found) == raw
    assert [s.kind for s in found if s.kind != "text"] == ["create", "insert", "copy", "insert", "insert", "insert", "insert", "create"]
    assert [s.kind for s in sqltext.segments(raw.splitlines(True), "sqlite")].count("copy") == 0


def test_masked_dump(spark, files):
    code, text = run(spark, files)
    assert code == 0
    lines = text.splitlines()
    assert lines[0].startswith("-- veilwork-seal:") and lines[1] == "-- start"
    users = next(x for x in lines if x.startswith('INSERT INTO "public"."users"'))
    assert users.endswith(" ON CONFLICT DO NOTHING;") and "(2, NULL)" in users and "::jsonb" in users and "(5, DEFAULT)" not in users and "(5, NULL)" in users and "it's" not in text
    copied = lines[lines.index("COPY public.users (id, email) FROM stdin;") + 1 : lines.index("\\.")]
    assert [c.split("\t")[0] for c in copied] == ["1", "2", "6"] and copied[1] == "2\t\\N"
    assert all(len(c.split("\t")[1]) <= 12 for c in copied)
    third = users.split("(3, '")[1].split("'")[0]
    assert copied[0].split("\t")[1] == third  # the same source value, in INSERT and COPY
    assert "select 1; -- ; '" in text and "INSERT INTO other VALUES (1, 'x');" in text
    assert """VALUES (1, '{"p":{"email":"REDACTED","tier":"gold"}}'::jsonb), (2, '{bad}');""" in text
    assert "INSERT OR REPLACE INTO [t]([a],[b]) VALUES (1, NULL), (2, NULL);" in text
    assert "drop me" not in text and "INSERT INTO users" not in text
    again = cli.main(["-i", str(files / "out.sql"), "-o", str(files / "again.sql"), "-c", str(files / "p.toml")], spark=spark)
    assert again == 0 and (files / "again.sql").read_text() == text
    (files / "p.toml").write_text('[rules.t]\nb = { strategy = "redact" }')
    code = cli.main(["-i", str(files / "out.sql"), "-o", str(files / "third.sql"), "-c", str(files / "p.toml")], spark=spark)
    third = (files / "third.sql").read_text()
    assert code == 0 and third.count("veilwork-seal") == 1 and "REDACTED" in third


def test_gates(spark, files):
    assert run(spark, files, "--check") == (1, None)
    assert run(spark, files, "--strict-coverage", "--report", str(files / "r.json"))[0] == 0
    report = json.loads((files / "r.json").read_text())
    assert report["total_rows_dropped"] == 2 and report["sensitive_columns_covered"] == ["public.users.email", "users.email"] and report["deterministic_mapping_domains"][0]["domain"] == "d"
    (files / "p.toml").write_text('[rules.t]\na = { strategy = "null" }\n[sensitive_columns]\nt = ["b"]')
    (files / "out.sql").unlink()
    assert run(spark, files, "--strict-coverage") == (2, None)
    assert run(spark, files, "--scan-output", "--fail-on-findings") == (3, None)
    assert cli.main(["lint-policy", "-c", str(files / "p.toml")]) == 1
    assert run(spark, files, "--in-place")[0] == 1 and cli.main(["-i", str(files / "none.sql"), "-c", str(files / "p.toml")], spark=spark) == 1


def test_domain_tag(spark, files):
    (files / "p.toml").write_text('salt = "s"\n[rules.users]\nemail = { strategy = "string", length = 9, domain = "d" }')
    own, tagged = (run(spark, files, *more)[1].splitlines() for more in ((), ("--domain-tag", "another-map-v1")))
    p = policy.load(files / "p.toml")
    value = lambda tag: strategies.mask_value(p.rule("users", "email"), Profile(salt="s", tag=tag), "it's;")
    for lines, tag in ((own, TAG), (tagged, b"another-map-v1")):
        assert f"1\t{value(tag)}" in lines
    assert value(TAG) != value(b"another-map-v1") and own[0] != tagged[0]  # a seal of one tag isn't trusted under another


def test_scaffold_config(spark, files, capsys):
    assert cli.main(["scaffold-config", "-i", str(files / "d.sql"), "--infer-json-paths"], spark=spark) == 0
    text = capsys.readouterr().out
    assert '[rules."public.users"]' in text and '"payload.p.email" = { strategy = "email"' in text


def test_wrapped_inputs(spark, files):
    plain = run(spark, files)[1]
    with gzip.open(files / "d.gz", "wb") as f:
        f.write(DUMP.encode())
    with zipfile.ZipFile(files / "d.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.write(files / "d.gz", "d.sql")
    assert run(spark, files, name="d.gz") == (0, plain) and run(spark, files, name="d.zip") == (0, plain)
    with zipfile.ZipFile(files / "two.zip", "w") as z:
        z.writestr("a.txt", "x")
        z.writestr("b.txt", "x")
    with pytest.raises(detect.InputError, match="must hold one file"):
        detect.resolve(files / "two.zip")
    (files / "x.dump").write_bytes(b"PGDMP....")
    with pytest.raises(detect.InputError, match="was not found"):
        detect.resolve(files / "x.dump", pg_restore="no-such-tool")
    with pytest.raises(detect.InputError, match="allowed extensions"):
        detect.check_extension("a.dmp", [".SQL"])
    detect.check_extension("a.SQL", ["sql"])
    for data, said in ((b"\xff\xfea", "UTF-16"), (b"a\0b", "binary"), (b"PK\x03\x04", "BACPAC"), (b"PGDMP", "PostgreSQL")):
        (files / "m.sql").write_bytes(data)
        with pytest.raises(detect.InputError, match=said):
            detect.resolve(files / "m.sql", dialect="mssql")


def test_source_reads_tables(spark, files):
    rows = sqldump.read_table(spark, str(files / "d.sql"), "public.users").collect()
    assert len(rows) == 9 and {r.id for r in rows} == set("123456") and any(r.email == "a\tb" for r in rows) and any(r.email == "it's;" for r in rows)
    with pytest.raises(sqltext.DumpError, match="not in the dump"):
        sqldump.read_table(spark, str(files / "d.sql"), "nope")


def test_large_copy_is_read_in_pieces(spark, tmp_path, monkeypatch):
    from veilwork.sources import dumpreader

    path = tmp_path / "big.sql"
    path.write_text("COPY t (a) FROM stdin;\n" + "".join(f"{i}\n" for i in range(5000)) + "\\.\n")
    monkeypatch.setattr(dumpreader, "PIECE_BYTES", 1000)
    pieces = dumpreader._pieces(str(path), dumpreader.index(str(path)), None)
    assert len(pieces) > 10
    reader = dumpreader._Reader({"path": str(path)})
    assert [r[4][0] for p in pieces for r in reader.read(p)] == [str(i) for i in range(5000)]


def test_errors():
    for text, said in (("COPY t (a) FROM stdin WITH (FORMAT csv);\n1\n\\.\n", "options"), ("COPY t (a) FROM stdin;\n1\n", "no end")):
        with pytest.raises(sqltext.DumpError, match=said):
            list(sqltext.segments(text.encode().splitlines(True)))
    with pytest.raises(sqltext.DumpError):
        sqltext.rows("(1, 'x", 0)
    assert sqltext.copy_encoded(sqltext.copy_decoded(r"a\tb\\n\n")) == r"a\tb\\n\n" and sqltext.copy_decoded("\\N") is None


COMMENTED = """CREATE TABLE users (id int, -- the user's id
  email varchar(12), /* ssn, phone (
  or not */ ssn text -- it's "secret",
);
INSERT INTO users VALUES (1, 'alice@example.com', '123-45-6789');
"""


def test_comments_in_a_definition_hide_no_column(spark, files):
    found = next(s for s in sqltext.segments(COMMENTED.encode().splitlines(True)) if s.kind == "create")
    assert found.more["definition"] == [("id", None), ("email", 12), ("ssn", None)]
    (files / "c.sql").write_text(COMMENTED)
    (files / "p.toml").write_text('[rules.users]\nemail = { strategy = "redact" }\n')
    code, text = run(spark, files, "--strict-coverage", name="c.sql")
    assert code == 2 and text is None
    (files / "p.toml").write_text('[rules.users]\nemail = { strategy = "redact" }\nssn = { strategy = "redact" }\n')
    code, text = run(spark, files, "--strict-coverage", name="c.sql")
    assert code == 0 and "VALUES (1, 'REDACTED', 'REDACTED');" in text and "-- the user's id" in text


def test_long_inserts_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Cuts lie between rows, whatever rows and line ends look like; the masked dump is the same however it is cut."""
    rows = [f"({i}, 'a;b(\n, (''{i}')" for i in range(60)]
    text = "INSERT INTO t (a, b)\nVALUES\n" + ",\n".join(rows[:30]) + "\n  , " + "\n,".join(rows[30:]) + "\nON CONFLICT (a, b)\n DO NOTHING -- ); (\n;\nSELECT 1;\n"
    (tmp_path / "d.sql").write_text(text)
    raw = text.encode().splitlines(True)
    whole, cut = list(sqltext.segments(raw)), list(sqltext.segments(raw, cut_bytes=50))
    assert whole[0].more == {"cuts": [], "tail": "ON CONFLICT (a, b)\n DO NOTHING -- ); (\n;\n"} == {**cut[0].more, "cuts": []} and len(cut[0].more["cuts"]) > 10
    assert [(s.kind, s.start, s.end) for s in whole] == [(s.kind, s.start, s.end) for s in cut]
    from veilwork.sources import dumpreader

    monkeypatch.setattr(dumpreader, "PIECE_BYTES", 50)
    pieces = dumpreader._pieces(str(tmp_path / "d.sql"), dumpreader.index(str(tmp_path / "d.sql")), "t")
    assert len(pieces) > 10
    reader = dumpreader._Reader({"path": f"file://{tmp_path}/d.sql"})
    got = [row for p in pieces for row in reader.read(p)]
    assert [r[4] for r in got] == [[str(i), f"a;b(\n, ('{i}"] for i in range(60)] and [r[2] for r in got] == sorted({r[2] for r in got})


def test_stores_that_arrow_reads(tmp_path):
    (tmp_path / "x").write_bytes(b"one\ntwo\nthree")
    with opening.stored(f"file://{tmp_path}/x") as a, opening.opened(str(tmp_path / "x")) as b:
        for f in (a, b):
            assert f.readline() == b"one\n" and f.tell() == 4 and list(f) == [b"two\n", b"three"]
            f.seek(5)
            assert f.read(2) == b"wo"


def test_standard_input(spark, files, monkeypatch, capsysbinary):
    import io
    import types

    monkeypatch.setattr(cli.sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(b"INSERT INTO users (id, email) VALUES (1, 'a@b.co');\n")))
    (files / "p.toml").write_text('[rules.users]\nemail = { strategy = "redact" }\n')
    assert cli.main(["-c", str(files / "p.toml")], spark=spark) == 0
    assert capsysbinary.readouterr().out.endswith(b"INSERT INTO users (id, email) VALUES (1, 'REDACTED');\n")


def test_archives_go_through_the_tool(spark, files):
    """A stand-in for the tool: it writes a dump and fails if asked to."""
    tool = files / "restore"
    tool.write_text("#!/bin/sh\ncase \"$3\" in --fail) echo broken >&2; exit 3;; esac\necho \"INSERT INTO users (id, email) VALUES (1, 'x@y.zz');\"\n")
    tool.chmod(0o755)
    (files / "a.dump").write_bytes(b"PGDMP\x01rest")
    (files / "p.toml").write_text('[rules.users]\nemail = { strategy = "redact" }\n')
    code, text = run(spark, files, "--pg-restore-path", str(tool), "--stats", name="a.dump")
    assert code == 0 and "VALUES (1, 'REDACTED');" in text and (files / "a.dump").exists()
    assert run(spark, files, "--pg-restore-path", str(tool), "--pg-restore-arg=--fail", name="a.dump")[0] == 1


def test_stats_line(spark, files, capsys):
    (files / "p.toml").write_text(POLICY)
    assert run(spark, files, "--stats")[0] == 0
    assert "rows=" in (line := capsys.readouterr().err) and "dropped=2" in line and "wall_ms=" in line


def test_rows_below_their_columns_are_found_in_time():
    head = b"INSERT INTO t (customer_id, nation_key) VALUES\n"
    rows = [b"(1, 'a;''(b')", b"(now(), E'a\\'b;')", b"(-1, e'x'::text)", b"((2), f('a', 'b'))", b"(NULL, 'type''z')"]
    lines = [x for _ in range(40) for x in (head, b"  " + b", ".join(rows) + b"\n", b"ON CONFLICT DO NOTHING;\n")]
    began = time.monotonic()
    found = list(sqltext.segments(lines))
    assert time.monotonic() - began < 5  # a list of names was cut in all ways: some seconds a statement
    assert [(s.kind, s.columns, s.more["tail"]) for s in found] == [("insert", ["customer_id", "nation_key"], "ON CONFLICT DO NOTHING;\n")] * 40
    cells, tail = sqltext.rows(b"".join(lines[:3]).decode(), len(found[0].header))
    assert tail == "ON CONFLICT DO NOTHING;\n" and [[c.value for c in row] for row in cells] == [["1", "a;'(b"], ["now()", "a'b;"], ["-1", "x"], ["(2)", "f('a', 'b')"], [None, "type'z"]]
    assert cells[2][1] == sqltext.Cell("x", True, None, "::text")
