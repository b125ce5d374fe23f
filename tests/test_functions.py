import random

import pytest
from pyspark.sql import functions as F

from bough.functions import config, decode, linediff, octets, pathspec
from bough.functions import cursor as C
from bough.model import CODES, EngineError, Limits


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("src", "src/a/b", True), ("src", "srcs", False), ("src/", "src/a", True), ("*.txt", "a.txt", True), ("*.txt", "d/a.txt", False), ("**/*.txt", "a.txt", True), ("**/*.txt", "d/e/a.txt", True),
        ("d/**/x", "d/x", True), ("d/**/x", "d/a/b/x", True), ("d/**", "d/a/b", True), ("d/**", "d", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab]x", "bx", True), ("[!ab]x", "bx", False),
        ("[!ab]x", "cx", True), ("[^/]", "/", False), (":(glob)src", "src", True), (":(glob)src", "src/a", False), ("a\\*b*", "a*bc", True), ("x**y", "xaay", True), ("x**y", "xa/y", False),
    ],
)
def test_pathspec(spark, pattern, path, hit):
    assert one(spark, pathspec.matches(F.lit(path), [pattern])) is hit


def test_pathspec_none_and_pruning(spark):
    assert one(spark, pathspec.matches(F.lit("x"), [])) is True
    may = lambda d, p: one(spark, pathspec.may_hold(F.lit(d), [p]))
    assert may("src", "src/a/*.c") and may("src/a", "src/a/*.c") and not may("lib", "src/a/*.c") and may("lib", "**/x") and may("src/a", "src")


@pytest.mark.parametrize(("size", "binary"), [(7999, True), (8000, False)])
def test_binary_probe(spark, size, binary):
    assert one(spark, octets.is_binary(F.lit(b"x" * size + b"\0"))) is binary


def test_object_id_of_empty_blob(spark):
    assert one(spark, octets.object_id("blob", F.lit(b""))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


@pytest.mark.parametrize(("data", "n"), [(b"", 0), (b"a", 1), (b"a\n", 1), (b"a\nb", 2), (b"\n\n", 2)])
def test_lines(spark, data, n):
    assert one(spark, octets.line_count(F.lit(data))) == n
    assert one(spark, F.size(octets.lines(octets.chars(F.lit(data))))) == n


@pytest.mark.parametrize(("zone", "minutes"), [("+0130", 90), ("-0800", -480), ("-0000", 0), ("+2400", None), ("+0060", None), ("0100", None)])
def test_zones(spark, zone, minutes):
    assert one(spark, octets.tz_offset_minutes(F.lit(zone.encode()))) == minutes
    assert decode.zone_minutes(zone.encode()) == minutes


@pytest.mark.parametrize(
    ("name", "good"),
    [("HEAD", True), ("refs/heads/main", True), ("refs/heads/a..b", False), ("refs/heads/.a", False), ("refs/heads/a.lock", False), ("refs/heads/a b", False), ("heads/main", False), ("refs/heads/a@{1}", False), ("refs//a", False), ("refs/a.", False), ("refs/", False)],
)
def test_ref_names(spark, name, good):
    assert one(spark, octets.is_ref_name(F.lit(name))) is good


@pytest.mark.parametrize(("path", "good"), [("", True), ("a/b", True), ("a//b", False), ("a/../b", False), (".", False), ("/a", False), ("a/", False), ("a/.b", True), ("a/...", True)])
def test_paths(spark, path, good):
    assert one(spark, octets.is_path(F.lit(path))) is good


POINTER = "version https://git-lfs.github.com/spec/v1\noid sha256:" + "a" * 64 + "\nsize 12\n"


@pytest.mark.parametrize(
    ("text", "good"),
    [
        (POINTER, True), (POINTER.replace("\n", "\r\n"), True), (POINTER.strip(), True), ("  " + POINTER, True), (POINTER.replace("size 12", "size -1"), False), (POINTER.replace("size 12", "size 99999999999999999999"), False),
        (POINTER.replace("git-lfs", "other"), False), (POINTER + "extra x\n", False), (POINTER.replace("oid", "ext-0-foo sha256:" + "b" * 64 + "\noid"), True), (POINTER + " " * 1024, False), ("", False),
        (POINTER.replace("oid sha256:" + "a" * 64 + "\nsize 12", "size 12\noid sha256:" + "a" * 64), False),
    ],
)
def test_lfs(spark, text, good):
    got = one(spark, octets.lfs_pointer(F.lit(text.encode())))
    assert (got is not None) is good
    if good:
        assert (got.oid, got.size) == ("a" * 64, 12)


def test_cursor_round_trip_and_checks():
    c = C.Cursor(b"s" * 20, "search", 7, b"position")
    text = c.encode()
    assert C.decode(text, b"s" * 20, "search", 7) == c
    for bad in (lambda: C.decode(text, b"t" * 20, "search", 7), lambda: C.decode(text, b"s" * 20, "log", 7), lambda: C.decode(text, b"s" * 20, "search", 8), lambda: C.decode(text[:-2], b"s" * 20, "search", 7), lambda: C.decode("!" + text, b"s" * 20, "search", 7), lambda: C.decode("A" * 9000, b"s" * 20, "search", 7)):
        with pytest.raises(EngineError) as e:
            bad()
        assert e.value.code == "invalid_cursor"
    assert C.fnv1a_64(b"") == 0xCBF29CE484222325 and C.fnv1a_64(b"a") == 0xAF63DC4C8601EC8C
    assert C.fingerprint({"a": 1, "limit": 5}) == C.fingerprint({"a": 1, "limit": 9})


def test_errors_and_limits():
    assert len(CODES) == 39
    with pytest.raises(EngineError):
        Limits(max_results=0)
    with pytest.raises(TypeError):
        Limits(max_results="1")


def test_config():
    data = b'[submodule "A.b"]\n\tpath = mods/a # note\n\turl = "https://x/y;z"\n; all\n[SubModule "q\\"z"]\nPath=one\\\ntwo\n\turl = a  b \\t\r\n\tbranch\n'
    assert config.declarations(data) == [{"name": b"A.b", "path": b"mods/a", "url": b"https://x/y;z", "branch": None}, {"name": b'q"z', "path": b"onetwo", "url": b"a  b \t", "branch": None}]
    for bad, line in ((b"[submodule\n", 1), (b"[a]\nx = \\q\n", 2), (b"path = x\n", 1), (b'[a]\nx = "y\n', 2)):
        with pytest.raises(EngineError) as e:
            list(config.parse(bad))
        assert e.value.code == "malformed_object" and e.value.details["line"] == line


def test_decode_commit_and_tag():
    raw = b"tree " + b"1" * 40 + b"\nparent " + b"2" * 40 + b"\nparent " + b"3" * 40 + b"\nauthor A  B <a@b> 12 -0730\ncommitter C <> -5 +0000\ngpgsig x\n y\n z\nencoding latin1\n\nsubject\n\nbody"
    c = decode.commit(raw)
    assert [p.hex() for p in c["parents"]] == ["2" * 40, "3" * 40]
    assert c["author"] == {"name": b"A  B", "email": b"a@b", "time": 12, "tz": b"-0730", "tz_offset_minutes": -450}
    assert c["committer"]["time"] == -5 and c["encoding"] == b"latin1" and c["signature_headers"] == [b"gpgsig"] and c["subject"] == b"subject" and c["message_raw"] == b"subject\n\nbody"
    t = decode.tag(b"object " + b"1" * 40 + b"\ntype commit\ntag v1\n\nm")
    assert t["tagger"] is None and t["name"] == b"v1"
    with pytest.raises(EngineError):
        decode.commit(b"parent " + b"2" * 40)


def test_decode_tree():
    entries = [(0o100644, b"a-b", b"1" * 20), (0o40000, b"a", b"2" * 20), (0o100755, b"a.txt", b"3" * 20), (0o160000, b"m", b"4" * 20)]
    got = decode.tree(decode.encode_tree(entries))
    assert [(n, k) for _, n, _, k in got] == [(b"a-b", "blob"), (b"a.txt", "blob"), (b"a", "tree"), (b"m", "gitlink")]
    for bad in (b"100644 a", b"8 a\0" + b"1" * 20, b"0 a\0" + b"1" * 20, b"100644 ..\0" + b"1" * 20, b"100644 a/b\0" + b"1" * 20, b"100644 a\0" + b"1" * 19):
        with pytest.raises(EngineError):
            decode.tree(bad)


def test_percent():
    for raw in (b"a%b", b"\xff\xfe", "ü".encode(), b"\x01\n", b""):
        assert decode.percent_decode(decode.percent_encode(raw)) == raw
    assert decode.percent_encode(b"100%\xff") == "100%25%FF"
    with pytest.raises(EngineError):
        decode.percent_decode("%4")


def _patched(old, new, hunks):
    lines, out, i = linediff.split(old), [], 0
    end = linediff.split(new)
    for h in hunks:
        start = h.old_start - 1 if h.old_lines else h.old_start
        out += lines[i:start]
        i = start
        for origin, content, a, b, _ in h.lines:
            if origin != "addition":
                assert linediff._bare(lines[i]) == content and a == i + 1
                i += 1
            if origin != "deletion":
                out.append(end[b - 1])
    return b"".join(out + lines[i:])


def test_diffs_apply_and_keep_common_lines():
    dice = random.Random(5)
    for _ in range(1500):
        k = dice.choice([2, 3, 6, 30])
        a = [b"%s%d\n" % (b" " * dice.choice([0, 0, 4]), dice.randrange(k)) if dice.random() < 0.9 else b"\n" for _ in range(dice.randrange(14))]
        b = list(a)
        for _ in range(dice.randrange(5)):
            if b and dice.random() < 0.5:
                del b[dice.randrange(len(b))]
            else:
                b.insert(dice.randrange(len(b) + 1), b"%d\n" % dice.randrange(k))
        old, new = b"".join(a), b"".join(b)
        old = old[:-1] if dice.random() < 0.3 else old
        gone, added = linediff.changes(linediff.split(old), linediff.split(new))
        assert [x for x, d in zip(linediff.split(old), gone) if not d] == [x for x, d in zip(linediff.split(new), added) if not d]
        assert _patched(old, new, linediff.hunks(old, new, dice.choice([0, 1, 3]))) == new


def test_zero_sided_hunks_and_missing_newlines():
    (h,) = linediff.hunks(b"a\nb\n", b"a\nx\nb\n", 0)
    assert (h.old_start, h.old_lines, h.new_start, h.new_lines) == (1, 0, 2, 1)
    (h,) = linediff.hunks(b"", b"a", 3)
    assert (h.old_start, h.old_lines, h.new_start, h.new_lines) == (0, 0, 1, 1) and h.lines[0][4] is True
    (h,) = linediff.hunks(b"a\nb", b"a\nb\n", 3)
    assert [(x[0], x[4]) for x in h.lines] == [("context", False), ("deletion", True), ("addition", False)]
    assert len(linediff.hunks(b"".join(b"%d\n" % i for i in range(30)), b"".join(b"%d\n" % i for i in range(30) if i not in (3, 25)), 3)) == 2


def test_similarity():
    a = b"".join(b"line %d\n" % i for i in range(20))
    assert linediff.similarity(a, a) == 1 and 0.9 < linediff.similarity(a, a.replace(b"line 3\n", b"line x\n")) < 1


def test_lfs_reads_a_payload_once(spark):
    """No part of the check is written out, and so computed, again where it is used."""
    got = spark.createDataFrame([(bytearray(POINTER.encode()),)], "data binary").select(octets.lfs_pointer(F.col("data")).alias("p"))
    assert got._jdf.queryExecution().analyzed().toString().count("is_valid_utf8") == 1
    assert tuple(got.first().p) == ("a" * 64, 12)
