"""BCF, BigWig and BigBed: files built here byte by byte, read whole, in splits and by region."""

import struct
import zlib

import pytest

from locusflow import api as lf
from locusflow.sources import bbi, files

HEADER = """##fileformat=VCFv4.3
##contig=<ID=c1,length=1000>
##contig=<ID=c2,length=1000>
##INFO=<ID=DP,Number=1,Type=Integer,Description="d">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="b">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
"""
STRINGS = {"PASS": 0, "DP": 1, "AF": 2, "DB": 3, "GT": 4}


def text(s):
    return bytes([len(s) << 4 | 7]) + s.encode()


def ints(*v):
    return bytes([len(v) << 4 | 1]) + struct.pack(f"<{len(v)}b", *v)


def record(chrom, pos, name, ref, alts, gts, dp=None, af=None, flag=False):
    info = []
    if dp is not None:
        info.append(ints(1) + ints(dp))
    if af is not None:
        info.append(ints(2) + bytes([len(af) << 4 | 5]) + b"".join(struct.pack("<I", 0x7F800001) if x is None else struct.pack("<f", x) for x in af))
    if flag:
        info.append(ints(3) + b"\x00")
    shared = struct.pack("<iiifII", chrom, pos - 1, len(ref), 30.5, (1 + len(alts)) << 16 | len(info), 1 << 24 | 2)
    shared += text(name) + text(ref) + b"".join(map(text, alts)) + ints(0) + b"".join(info)
    indiv = ints(4) + bytes([2 << 4 | 1]) + b"".join(struct.pack("<2b", *g) for g in gts)
    return struct.pack("<II", len(shared), len(indiv)) + shared + indiv


@pytest.fixture(scope="module")
def bcf(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("bcf") / "a.bcf")
    head = HEADER.encode() + b"\0"
    data = b"BCF\2\2" + struct.pack("<I", len(head)) + head
    data += record(0, 10, "rs1", "A", ["C"], [(2, 4), (4, 5)], 7, [0.5], True) + record(1, 20, "", "GT", ["G"], [(0, 0), (2, 3)], None, [None])
    for k in range(400):
        data += record(k % 2, 100 + k, f"x{k}", "A", ["T"], [(2, 2), (4, 4)], k % 100)
    with open(p, "wb") as f:
        for k in range(0, len(data), 900):
            files.write_bgzf(f, data[k : k + 900], False)
        files.write_bgzf(f, b"", True)
    return p


def test_bcf(spark, bcf):
    for size in (1 << 20, 700):
        df = lf.read_bcf(spark, bcf, split_bytes=size)
        assert df.count() == 402
        a, b = df.filter("start < 50").orderBy("start").collect()
        assert (a["chrom"], a["start"], a["id"], a["ref"], a["alt"], a["qual"], a["filter"], a["DP"], a["AF"], a["DB"]) == ("c1", 10, "rs1", "A", "C", 30.5, "PASS", 7, [0.5], True)
        assert a["genotypes"]["GT"] == ["0/1", "1|1"] and b["genotypes"]["GT"] == ["./.", "0|0"] and b["AF"] is None and b["end"] == 21 and b["DB"] is False
    d = lf.read_bcf(spark, bcf, format_fields=["GT"], genotype_output="dosage").filter("start < 50").orderBy("start").collect()
    assert [r["genotypes"]["GT"] for r in d] == [[1, 2], [None, 0]]
    with pytest.raises(ValueError):
        lf.read_bcf(spark, bcf, genotype_output="dosage")
    assert {r["name"] for r in lf.describe_bcf(spark, bcf).collect()} == {"DP", "AF", "DB", "genotypes"}


def bbi_file(path, wig, blocks, contigs, sql=""):
    """blocks: (contig id, start, end, raw section)."""
    packed = [zlib.compress(b[3]) for b in blocks]
    tree_at = 64 + len(sql) + 1
    key = max(len(n) for n, _ in contigs)
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 256, key, 8, len(contigs), 0) + struct.pack("<BBH", 1, 0, len(contigs))
    tree += b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", k, size) for k, (n, size) in enumerate(contigs))
    data_at = tree_at + len(tree)
    offsets, at = [], data_at
    for p in packed:
        offsets.append(at)
        at += len(p)
    index = struct.pack("<IIQIIIIQII", 0x2468ACE0, 256, len(blocks), 0, 0, len(contigs) - 1, 1 << 20, at, 1, 0) + struct.pack("<BBH", 1, 0, len(blocks))
    index += b"".join(struct.pack("<IIIIQQ", b[0], b[1], b[0], b[2], o, len(p)) for b, o, p in zip(blocks, offsets, packed))
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26 if wig else 0x8789F2EB, 4, 0, tree_at, data_at, at, 0 if wig else 5, 3, 64 if sql else 0, 0, 1 << 16, 0)
    with open(path, "wb") as f:
        f.write(head + sql.encode() + b"\0" + tree + b"".join(packed) + index)


def test_bigwig(spark, tmp_path):
    p = str(tmp_path / "a.bw")
    sections = [
        (0, 0, 30, struct.pack("<IIIIIBBH", 0, 0, 30, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 0, 10, 1.5, 20, 30, 2.0)), (0, 100, 130, struct.pack("<IIIIIBBH", 0, 100, 130, 0, 5, 2, 0, 2) + struct.pack("<IfIf", 100, 3.0, 120, 4.0)),
        (1, 50, 80, struct.pack("<IIIIIBBH", 1, 50, 80, 10, 5, 3, 0, 3) + struct.pack("<3f", 5.0, 6.0, 7.0)),
    ]
    bbi_file(p, True, sections, [("chr1", 500), ("chr2", 400)])
    want = [("chr1", 1, 10, 1.5), ("chr1", 21, 30, 2.0), ("chr1", 101, 105, 3.0), ("chr1", 121, 125, 4.0), ("chr2", 51, 55, 5.0), ("chr2", 61, 65, 6.0), ("chr2", 71, 75, 7.0)]
    df = lf.read_bigwig(spark, p)
    assert [tuple(r) for r in df.collect()] == want
    assert [tuple(r) for r in df.filter("chrom = 'chr1' and start > 100").collect()] == want[2:4]
    assert lf.read_bigwig(spark, p, zero_based=True).first()["start"] == 0
    assert len(bbi.BbiFile(p).blocks({0}, 100, 200)) == 1
    with pytest.raises(ValueError):
        lf.read_bigbed(spark, p)


def test_bigbed(spark, tmp_path):
    p = str(tmp_path / "a.bb")
    sql = 'table t\n"x"\n(\nstring chrom; "c"\nuint chromStart; "s"\nuint chromEnd; "e"\nstring name; "n"\nuint score; "s"\n)'
    rows = [(0, 1, 5, "a\t7"), (0, 9, 12, "b\t")]
    bbi_file(p, False, [(0, 1, 12, b"".join(struct.pack("<III", c, s, e) + r.encode() + b"\0" for c, s, e, r in rows))], [("chr1", 500)], sql)
    assert [tuple(r) for r in lf.read_bigbed(spark, p).collect()] == [("chr1", 2, 5, "a", 7), ("chr1", 10, 12, "b", None)]
    assert lf.read_bigbed(spark, p, schema="rest").columns == ["chrom", "start", "end", "rest"]
    lf.register_bigbed(spark, p, "bb")
    assert lf.sql(spark, "select count(*) as n from bb where chrom = 'chr1' and start >= 10").first()["n"] == 1


def bgen_file(path, compressed, samples=True):
    def variant(rsid, chrom, pos, alleles, body):
        head = b"".join(struct.pack("<H", len(x)) + x.encode() for x in ("id" + rsid, rsid, chrom)) + struct.pack("<IH", pos, len(alleles)) + b"".join(struct.pack("<I", len(a)) + a.encode() for a in alleles)
        data = struct.pack("<I", len(body)) + zlib.compress(body) if compressed else body
        return head + struct.pack("<I", len(data)) + data

    def body(k, ploidy, phased, bits, numbers):
        raw = "".join(format(x, f"0{bits}b")[::-1] for x in numbers)
        raw += "0" * (-len(raw) % 8)
        packed = bytes(int(raw[i : i + 8][::-1], 2) for i in range(0, len(raw), 8))
        return struct.pack("<IHBB", len(ploidy), k, 2, 2) + bytes(ploidy) + bytes([phased, bits]) + packed

    rows = [
        variant("rs1", "1", 100, ["A", "G"], body(2, [2, 2, 0x82], 0, 8, [255, 0, 0, 255, 0, 0])), variant("rs2", "1", 200, ["AC", "G"], body(2, [2, 2, 2], 1, 4, [15, 0, 0, 0, 15, 15])),
        variant("rs3", "2", 300, ["A", "G"], body(2, [2, 2, 2], 0, 16, [32768, 16384, 0, 0, 65535, 0])),
    ]
    names = b"".join(struct.pack("<H", len(x)) + x.encode() for x in ("s1", "s2", "s3"))
    names = struct.pack("<II", 8 + len(names), 3) + names if samples else b""
    head = struct.pack("<II", 20, 3) + struct.pack("<I", 3) + b"bgen" + struct.pack("<I", (1 if compressed else 0) | 2 << 2 | (1 << 31 if samples else 0))
    with open(path, "wb") as f:
        f.write(struct.pack("<I", 20 + len(names)) + head + names + b"".join(rows))


@pytest.mark.parametrize("compressed", [True, False])
def test_bgen(spark, tmp_path, compressed):
    import sqlite3

    p = str(tmp_path / "a.bgen")
    bgen_file(p, compressed)
    df = lf.read_bgen(spark, p)
    a, b, c = df.orderBy("start").collect()
    assert (a["chrom"], a["start"], a["end"], a["id"], a["rsid"], a["alleles"], a["phased"], a["bits"]) == ("1", 100, 100, "idrs1", "rs1", ["A", "G"], False, 8) and b["end"] == 201 and b["phased"]
    assert a["genotypes"]["GP"] == [[1, 0, 0], [0, 1, 0], None] and a["genotypes"]["PLOIDY"] == [2, 2, 2]
    assert b["genotypes"]["GP"] == [[1, 0, 0, 1], [0, 1, 0, 1], [1, 0, 1, 0]]
    d = lf.read_bgen(spark, p, genotype_output="dosage", samples=["s3", "s1"]).orderBy("start").collect()
    assert d[0]["genotypes"]["DS"] == [None, 0.0] and d[1]["genotypes"]["DS"] == [0.0, 1.0] and abs(d[2]["genotypes"]["DS"][1] - 0.75) < 1e-4
    assert lf.read_bgen(spark, p, genotype_fields=[]).columns == ["chrom", "start", "end", "id", "rsid", "alleles"]
    values, positions, names = lf.read_bgen_matrix(spark, p)
    assert values.shape == (3, 3) and list(positions) == [100, 200, 300] and names == ["s1", "s2", "s3"] and values[1].tolist() == [1, 2, 0] and values[0, 2] != values[0, 2]
    with pytest.raises(ValueError):
        lf.read_bgen_matrix(spark, p, max_values=5)
    with pytest.raises(ValueError):
        lf.read_bgen(spark, p, samples=["none"])
    from locusflow.sources.bgen import BgenHeader, Region, _read, offsets, variant_head

    db = sqlite3.connect(p + ".bgi")
    db.execute("create table Variant (chromosome text, position int, file_start_position int)")
    with open(p, "rb") as f:
        here = BgenHeader(p).first
        for _ in range(3):
            f.seek(here)
            v = variant_head(f)
            db.execute("insert into Variant values (?, ?, ?)", (v[2], v[3], here))
            size = _read(f, "I")
            here = f.tell() + size
    db.commit()
    db.close()
    region = Region()
    region.chroms = {"1"}
    assert len(offsets(p, BgenHeader(p), region, False)) == 2
    assert lf.read_bgen(spark, p).filter("chrom = '1' and start > 150").count() == 1
    assert {r["property"] for r in lf.describe_bgen(spark, p).collect()} >= {"n_variants", "samples"}


def test_records_of_a_batch_are_those_made_one_by_one():
    import random

    import pyarrow as pa

    from locusflow.sources import bam

    r = random.Random(9)
    names, tags = {"c1": 0, "c2": 1}, {"NM": "i", "AS": "f", "RG": "Z"}
    rows = []
    for k in range(300):
        n = r.choice((0, 1, 4, 7))
        rows.append({
            "name": r.choice((None, "", "q", f"read{k}")), "chrom": r.choice((None, "c1", "c2", "c3")), "start": r.choice((None, 0, 1, 20_000, 2**29)), "flags": r.choice((None, 4, 1024)), "cigar": r.choice((None, "*", f"{n}M", "3M1I2D10N4S")), "mapping_quality": r.choice((None, 0, 60)),
            "mate_chrom": r.choice((None, "c2")), "mate_start": r.choice((None, 7)), "template_length": r.choice((None, -9)), "sequence": r.choice((None, "*", "acgTN"[:n])), "quality_scores": r.choice((None, "*", "I" * n, "!#~AB"[:n])),
            "NM": r.choice((None, 0, -3, 2**31 - 1)), "AS": r.choice((None, 1.5)), "RG": r.choice((None, "", "grp")),
        })
    schema = pa.schema([(c, pa.string() if c in ("name", "chrom", "cigar", "mate_chrom", "sequence", "quality_scores", "RG") else pa.float32() if c == "AS" else pa.int64()) for c in rows[0]])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    want = b"".join(bam.encode(x, names, tags) for x in rows)
    assert bam.encode_batch(batch, names, tags) == want
    assert bam.encode_batch(batch.slice(5, 9), names, tags) == b"".join(bam.encode(x, names, tags) for x in rows[5:14])
    assert bam.encode_batch(batch, names, {"NM": "c"}) is None and bam.encode_batch(batch, names, {"RG": "A"}) is None and bam.encode_batch(batch.select(["name", "chrom"]), names, {}) is not None
    # tags of one layout are read at once, others one by one
    alike = [x | {"NM": k, "AS": 0.5, "RG": None} for k, x in enumerate(rows)]
    for these in (alike, rows):
        data, kinds = b"".join(bam.encode(x, names, tags) for x in these), {"NM": "i", "AS": "f", "XX": "i"}
        got = bam.decode(data, list(names), True, [], kinds)
        assert got["NM"].to_pylist() == [x["NM"] for x in these] and got["AS"].to_pylist() == [x["AS"] for x in these] and got["XX"].null_count == len(these)
        assert bam.decode(data, list(names), True, ["cigar"], {})["cigar"].to_pylist() == [x["cigar"] if x["cigar"] else "*" for x in these]
