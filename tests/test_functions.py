import base64
import zlib

from pyspark.sql import functions as F

from shelfmark.functions import digests as D
from shelfmark.functions import scalars as S
from shelfmark.functions import values as V


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).collect()[0][0]


def test_golden_digests(spark):
    df = D.with_digests(spark.createDataFrame([(b"New sunset photo\n",), (b"",), (None,)], "c binary"), "c").collect()
    assert tuple(df[0])[1:] == ('"4f0db7a391ca51eb7d61e17d900f4f42"', "O3a4Zf1yiUM8LuBjtyz+G74fjkE/JJlCIfQpRrztubk=", "lLwcwr2Z8ugHJv5BRYa2s1IocqQ=", "A5ke1A==", "33wYfg==")
    assert df[1].checksum_crc32c == "AAAAAA==" and df[2].checksum_crc32c is None


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c_of_all_lengths():
    data = bytes(n * 7 % 251 for n in range(9000))
    for n in (0, 1, 255, 256, 1023, 1024, 1025, 4097, 9000):
        assert D.crc32c(data[:n]) == slow_crc32c(data[:n])
        assert D.crc32c(data[n:], D.crc32c(data[:n])) == slow_crc32c(data)
    assert D._crc32c_of([data[:5], None, b"", data[:4096], data]) == [slow_crc32c(data[:5]), None, 0, slow_crc32c(data[:4096]), slow_crc32c(data)]


def test_stream_digests(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"x" * 200_000)
    with open(path, "rb") as f:
        got = D.stream_digests(f, 1000)
    assert got["size"] == 200_000 and got["checksum_crc32"] == base64.b64encode(zlib.crc32(b"x" * 200_000).to_bytes(4, "big")).decode()


def test_spellings(spark):
    digest = bytes(range(32))
    b64, hexed = base64.b64encode(digest).decode(), digest.hex()
    for text in (b64, b64.rstrip("="), base64.urlsafe_b64encode(digest).decode(), hexed, hexed.upper(), f"sha256:{hexed}", f" {b64}\n", f"{b64}\n", f'"{b64}"'):
        assert bytes(one(spark, text, V.digest32)) == digest and one(spark, text, V.digest_text) == b64, text
    for text in ("", "abc", None, "x" * 64, "!" * 44):
        assert one(spark, text, V.digest32) is None
    uid = "0123abcd-4567-89ab-cdef-0123456789ab"
    for text in (uid, uid.upper(), "{" + uid + "}", uid.replace("-", ""), f" {uid} ", f"{uid}\n", f"urn:uuid:{uid}"):
        assert one(spark, text, V.canonical_uuid) == uid
    assert one(spark, " Odd ", V.canonical_uuid) == "odd" and one(spark, None, V.canonical_uuid) is None


def test_keys_and_times(spark):
    for text, plain in (("a%2fb%20c", "a/b c"), ("/a/b", "a/b"), ("a+b", "a b"), ("50%", "50%"), ("c%C3%B4t%C3%A9+n", "côté n"), ("", "")):
        assert one(spark, text, V.plain_key) == plain
    join = lambda p, n: spark.createDataFrame([(p, n)], "p string, n string").select(V.joined_path(F.col("p"), F.col("n"))).collect()[0][0]
    assert [join(p, "n") for p in ("a/b/", "a\\b\\", "./a//b", "/a/b", "", None)] == ["a/b/n"] * 4 + ["n", "n"]
    assert [one(spark, n, V.epoch_ns, "long") for n in (0, None, 1718202359, 1718202359008, 1718202359008001, 1718202359008001002)] == [None, None, 1718202359 * 10**9, 1718202359008 * 10**6, 1718202359008001 * 1000, 1718202359008001002]
    for n in (1718202359999999999, 1735689599999999999, -1, 0):
        assert one(spark, n, lambda c: F.unix_micros(V.ns_to_timestamp(c)), "long") == n // 1000
    assert [one(spark, t, V.known_text) for t in ("x", "", " ", '""', "Unknown", "application/octet-stream", None)] == ["x"] + [None] * 6


def test_scalars(spark):
    assert [one(spark, n, S.human_size, "long") for n in (0, 1023, 1024, 1536, 2304, 2408, 5 << 20, 3 << 30, None)] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "2.2 KB", "2.4 KB", "5.0 MB", "3.0 GB", None]
    assert [one(spark, t, S.duration_seconds) for t in ("90s", " 30m ", "1h", "7d", "", "x", "1.5h", "9")] == [90, 1800, 3600, 604800, None, None, None, None]
    assert [one(spark, t, S.bucket_name) for t in ("Photos", "My Photos", "ab", "/x/Hello__World..v2/", "---", "Ünï")] == ["photos", "my-photos", "ab-bucket", "hello-world.v2", "bucket", "n-bucket"]
    assert [one(spark, t, S.bucket_name_problem) for t in ("good-name.1", "ab", "1.2.3.4", "Bad", "-bad", "a..b", "999.1.1.1")] == [None, "invalid_length", "looks_like_ip_address", "invalid_characters", "invalid_start_end", "consecutive_hyphens_or_periods", None]
    assert one(spark, "a b/é~*", lambda c: S.uri_encode(c)) == "a%20b%2F%C3%A9~%2A" and one(spark, "a b/c", lambda c: S.uri_encode(c, True)) == "a%20b/c"
    assert one(spark, "Thu, 02 Jan 2025 03:04:05 GMT", lambda c: S.http_date(S.parse_http_date(c))) == "Thu, 02 Jan 2025 03:04:05 GMT"
    assert one(spark, "soon", S.parse_http_date) is None and one(spark, "20250102T030405Z", lambda c: S.rfc3339(S.parse_compact_date(c))) == "2025-01-02T03:04:05.000000Z"
    assert one(spark, "/b/k%20x/y", lambda c: S.bucket_and_key(c)["key"]) == "k x/y" and one(spark, "b", S.bucket_and_key) is None
    ranges = {"bytes=0-9": (0, 9), "bytes=5-": (5, 99), "bytes=-10": (90, 99), "bytes=-500": (0, 99), "bytes=-": None, "x": None, "bytes=a-1": None}
    for text, wanted in ranges.items():
        got = one(spark, text, lambda c: S.byte_range(c, F.lit(100).cast("long")))
        assert (tuple(got) if got else None) == wanted, text
    assert one(spark, '{"a":"b"}', S.json_map) == {"a": "b"} and one(spark, "nonsense", S.json_map) == {} and one(spark, None, S.json_map) == {}
    assert one(spark, {"X-Meta-A": "1", "Other": "2"}, lambda c: S.headers_with_prefix(c, "x-meta-"), "map<string,string>") == {"a": "1"}
    assert one(spark, "<a&'\">", S.xml_escape) == "&lt;a&amp;&apos;&quot;&gt;"
    assert [one(spark, n, S.readers_for, "long") for n in (1, 524288, 524289, 1048577, 8388609)] == [32, 32, 16, 8, 1]
    assert [one(spark, r, S.byte_budget_for, "double") for r in (None, 10.0, 1e12)] == [50 << 20, 1200, 50 << 30]
    assert [one(spark, k, S.names_a_file) for k in ("a/b", "", "/a", "a/../b", ".shelfmark/x", None, "a..b")] == [True, False, False, False, False, False, True]
    rate = lambda *v: spark.createDataFrame([v], "s double, d int, t int, e double").select(S.extrapolated_rate(F.col("s"), F.col("d"), F.col("t"), F.col("e"))).collect()[0][0]
    assert [rate(100.0, 1, 2, 10.0), rate(100.0, 0, 2, 10.0), rate(100.0, 1, 2, 0.0), rate(100.0, 0, 0, 1.0)] == [20.0, 10.0, None, None]
