"""Readers and writers: small files, splits against whole reads, round trips."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from locusflow import api as lf
from locusflow.sources import bam, fastq, files

VCF = """##fileformat=VCFv4.3
##FILTER=<ID=q10,Description="low, quality">
##contig=<ID=c1,length=5000>
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth, total">
##INFO=<ID=AF,Number=A,Type=Float,Description="frequency">
##INFO=<ID=ID2,Number=.,Type=String,Description="names">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{samples}
c1\t100\trs1\tA\tC,G\t30\tPASS\tDP;AF=0.5,.;ID2=x,.,y;DB\tGT:DP:AD\t{one}
c1\t200\t.\tGTT\tG\t.\t.\tDP=42;AF\tGT:DP\t{two}
c2\t300\trs3\tC\t.\t7.5\tq10\t.\tGT\t{three}
"""


@pytest.fixture
def vcf(tmp_path):
    def make(samples):
        n = len(samples)
        p = tmp_path / f"v{n}.vcf"
        p.write_text(VCF.format(samples="\t".join(samples), one="\t".join(["0/1:20:3,."] * n), two="\t".join(["1|1:."] * n), three="\t".join(["./."] * n)))
        return str(p)

    return make


def test_vcf_single_sample(spark, vcf):
    df = lf.read_vcf(spark, vcf(["S"]))
    assert df.columns == ["chrom", "start", "end", "id", "ref", "alt", "qual", "filter", "DP", "AF", "ID2", "DB", "GT", "fmt_DP", "AD"]
    a, b, c = df.collect()
    assert (a["start"], a["end"], a["alt"], a["qual"], a["DP"], a["ID2"], a["DB"], a["GT"], a["fmt_DP"], a["AD"]) == (100, 100, "C|G", 30.0, None, ["x", None, "y"], True, "0/1", 20, [3, None])
    assert a["AF"] == [0.5, None] and b["AF"] is None and b["DP"] == 42 and b["DB"] is False
    assert (b["end"], b["id"], b["qual"], b["filter"], b["fmt_DP"], b["AD"]) == (202, "", None, "", None, None)
    assert c["alt"] == "" and c["GT"] == "./."
    zero = lf.read_vcf(spark, vcf(["S"]), info_fields=[], format_fields=[], zero_based=True)
    assert zero.columns[-1] == "filter" and [r["start"] for r in zero.collect()] == [99, 199, 299] and lf.coordinate_system(zero) is True


def test_vcf_many_samples_and_description(spark, vcf):
    p = vcf(["S1", "S2"])
    df = lf.read_vcf(spark, p, info_fields=["DP"], format_fields=["GT", "DP"])
    assert df.first()["genotypes"].asDict() == {"GT": ["0/1", "0/1"], "DP": [20, 20]}
    assert lf.get_metadata(df)["header"]["sample_names"] == ["S1", "S2"]
    assert lf.read_vcf(spark, p, samples=["S2"], format_fields=["GT"]).first()["genotypes"]["GT"] == ["0/1"]
    with pytest.raises(ValueError):
        lf.read_vcf(spark, p, samples=["S9"])
    d = {(r["field_type"], r["name"]): r["data_type"] for r in lf.describe_vcf(spark, p).collect()}
    assert d["INFO", "AF"] == "Float" and d["FORMAT", "genotypes"] == "Struct" and ("FORMAT", "GT") not in d
    assert ("FORMAT", "fmt_DP") in {(r["field_type"], r["name"]) for r in lf.describe_vcf(spark, vcf(["S"])).collect()}


def test_vcf_flag_with_value_fails(spark, tmp_path):
    p = tmp_path / "bad.vcf"
    p.write_text('##fileformat=VCFv4.3\n##INFO=<ID=DB,Number=0,Type=Flag,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t1\t.\tA\tC\t.\t.\tDB=1\n')
    with pytest.raises(Exception, match="invalid flag"):
        lf.read_vcf(spark, str(p)).collect()
    assert lf.read_vcf(spark, str(p)).select("chrom").count() == 1


@pytest.mark.parametrize("samples", [["S"], ["S1", "S2"]])
@pytest.mark.parametrize("ext", ["vcf", "vcf.gz"])
def test_vcf_round_trip(spark, vcf, tmp_path, samples, ext):
    df = lf.read_vcf(spark, vcf(samples))
    out = str(tmp_path / f"out.{ext}")
    assert lf.write_vcf(df, out) == 3
    assert [r.asDict(True) for r in lf.read_vcf(spark, out).collect()] == [r.asDict(True) for r in df.collect()]
    assert files.compression(out) == ("bgzf" if ext.endswith("gz") else "none")


def test_bed_and_tables(spark, tmp_path):
    p = tmp_path / "x.bed"
    p.write_text("track name=a\n#c\nchr1\t10\t20\tf1\t960\t+\nchr2\t0\t5\tf2\t1\t-\n")
    assert [tuple(r) for r in lf.read_bed(spark, str(p)).collect()] == [("chr1", 11, 20, "f1"), ("chr2", 1, 5, "f2")]
    assert lf.read_bed(spark, str(p), zero_based=True).first()["start"] == 10
    assert lf.read_table(spark, str(p), "bed6").first()["strand"] == "+"
    with pytest.raises(ValueError):
        lf.read_table(spark, str(p), "bed2")


def test_features(spark, tmp_path):
    g = tmp_path / "a.gtf"
    g.write_text('##x\nchr1\tH\texon\t10\t20\t.\t+\t0\tgene_id "G;1"; level 2; tag "a"; tag "b";\n')
    df = lf.read_gtf(spark, str(g))
    assert [tuple(x) for x in df.first()["attributes"]] == [("gene_id", "G;1"), ("level", "2"), ("tag", "a"), ("tag", "b")]
    r = lf.read_gtf(spark, str(g), attr_fields=["tag", "gene_id", "none"], zero_based=True).first()
    assert (r["tag"], r["gene_id"], r["none"], r["start"], r["phase"], r["score"]) == ("a,b", "G;1", None, 9, 0, None)
    assert "attributes" not in lf.read_gtf(spark, str(g), attr_fields=[]).columns
    f = tmp_path / "a.gff3"
    f.write_text("##gff-version 3\nchr1\tH\tgene\t1\t5\t2.5\t-\t.\tID=g1;Note=a%2Cb;Name=x\n")
    r = lf.read_gff(spark, str(f), attr_fields=["ID", "Note"]).first()
    assert (r["ID"], r["Note"], r["score"]) == ("g1", "a,b", 2.5)


def test_pairs(spark, tmp_path):
    p = tmp_path / "a.pairs"
    p.write_text("## pairs format v1.0\n#columns: readID chr1 pos1 chr2 pos2 strand1 strand2\nr1\tchr1\t10\tchr2\t20\t+\t-\n")
    assert tuple(lf.read_pairs(spark, str(p)).first()) == ("r1", "chr1", 10, "chr2", 20, "+", "-")


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">s1 First > one\nACTG\nAC\n>s2\nGG\n>s3 x\n\n")
    want = [("s1", "First > one", "ACTGAC"), ("s2", None, "GG"), ("s3", "x", "")]
    df = lf.read_fasta(spark, str(p))
    assert [tuple(r) for r in df.collect()] == want
    out = str(tmp_path / "o.fasta")
    assert lf.write_fasta(df, out, width=2) == 3
    assert [tuple(r) for r in lf.read_fasta(spark, out).collect()] == want


def reads(n, seed=3):
    r = random.Random(seed)
    out = []
    for k in range(n):
        m = r.randint(0, 60)
        out.append((f"r{k}", None if k % 3 else "d @x", "".join(r.choice("ACGTN") for _ in range(m)), "".join(r.choice("@+!#I5") for _ in range(m))))
    return out


def as_text(rows):
    return "".join(f"@{a}{' ' + b if b else ''}\n{c}\n+\n{d}\n" for a, b, c, d in rows)


@pytest.mark.parametrize("kind", ["none", "gzip", "bgzf"])
def test_fastq_splits(spark, tmp_path, kind):
    rows = reads(400)
    data = as_text(rows).encode()
    p = tmp_path / ("a.fastq" + ("" if kind == "none" else ".gz"))
    if kind == "none":
        p.write_bytes(data)
    elif kind == "gzip":
        p.write_bytes(gzip.compress(data))
    else:
        with open(p, "wb") as f:
            for k in range(0, len(data), 700):
                files.write_bgzf(f, data[k : k + 700], False)
            files.write_bgzf(f, b"", True)
    for size in (1 << 20, 997, 300):
        got = fastq.numbered(spark, str(p), size).orderBy("_index").select(*fastq.COLUMNS).collect()
        assert [tuple(r) for r in got] == rows
    out = str(tmp_path / "o.fastq.bgz")
    assert lf.write_fastq(lf.read_fastq(spark, str(p)), out) == 400
    assert sorted(tuple(map(str, r)) for r in lf.read_fastq(spark, out).collect()) == sorted(tuple(map(str, r)) for r in rows)
    with pytest.raises(ValueError):
        lf.write_fastq(lf.read_fastq(spark, str(p)).drop("sequence"), out)


def test_bgzf_lines_by_split(spark, tmp_path):
    text = [f"line {k} " + "x" * (k % 50) for k in range(500)]
    p = tmp_path / "a.txt.bgz"
    data = "\n".join(text).encode()
    with open(p, "wb") as f:
        for k in range(0, len(data), 333):
            files.write_bgzf(f, data[k : k + 333], False)
        files.write_bgzf(f, b"", True)
    files.use(spark, files.LinesSource)
    for size in (150, 1000, 1 << 20):
        got = [r["value"] for r in spark.read.format("locusflow_lines").option("splitBytes", size).load(str(p)).collect()]
        assert sorted(got) == sorted(text)


def alignments(n):
    r = random.Random(5)
    out = ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:c1\tLN:100000", "@SQ\tSN:c2\tLN:50000", "@RG\tID:g\tSM:s"]
    for k in range(n):
        m = r.randint(5, 40)
        if k % 11 == 10:
            out.append("\t".join([f"q{k}", "4", "*", "0", "0", "*", "*", "0", "0", "A" * m, "I" * m, "RG:Z:g"]))
            continue
        cut = m // 2
        cigar = r.choice((f"{m}M", f"{cut}M3D{m - cut}M", f"{cut}M10N{m - cut}M", f"2S{m - 2}M"))
        out.append("\t".join([f"q{k}", "0", r.choice(("c1", "c2")), str(r.randint(1, 40000)), "60", cigar, "=", "7", "-3", "".join(r.choice("ACGT") for _ in range(m)), "".join(r.choice("!5I") for _ in range(m)), f"NM:i:{k % 5}", "XA:B:i,1,2", "XF:f:0.5"]))
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def sam(tmp_path_factory):
    p = tmp_path_factory.mktemp("sam") / "a.sam"
    p.write_text(alignments(300))
    return str(p)


def test_sam_and_bam_round_trips(spark, sam, tmp_path):
    tags = ["NM", "XA", "RG", "XF"]
    df = lf.read_sam(spark, sam, tag_fields=tags)
    assert dict(df.dtypes)["NM"] == "int" and dict(df.dtypes)["XA"] == "array<int>"
    want = [tuple(r) for r in df.collect()]
    assert len(want) == 300 and want[10][1:4] == (None, None, None)
    again = str(tmp_path / "b.sam")
    assert lf.write_sam(df, again) == 300
    assert [tuple(r) for r in lf.read_sam(spark, again, tag_fields=tags).collect()] == want
    p = str(tmp_path / "a.bam")
    assert lf.write_bam(df, p) == 300
    assert lf.get_metadata(lf.read_bam(spark, p))["header"]["read_groups"] == [{"ID": "g", "SM": "s"}]
    for size in (1 << 20, 2000):
        got = lf.read_bam(spark, p, tag_fields=tags, split_bytes=size)
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert lf.read_bam(spark, p, columns=["chrom", "start"]).columns == ["chrom", "start"]
    assert lf.read_bam(spark, p).filter("chrom = 'c1' and start < 2000").count() == df.filter("chrom = 'c1' and start < 2000").count()
    assert {r["column_name"] for r in lf.describe_bam(spark, p).collect()} >= {"name", "NM", "XA"}
    assert {r["column_name"] for r in lf.describe_sam(spark, sam).collect()} >= {"name", "NM", "XA"}
    s = str(tmp_path / "sorted.sam")
    lf.sink_sam(df, s, sort_on_write=True)
    got = [(r["chrom"], r["start"]) for r in lf.read_sam(spark, s).filter("chrom is not null").collect()]
    assert got == sorted(got) and "SO:coordinate" in open(s).readline()


def test_bam_record_search_in_small_blocks(spark, sam, tmp_path):
    p = str(tmp_path / "a.bam")
    lf.write_bam(lf.read_sam(spark, sam), p)
    data = gzip.decompress(open(p, "rb").read())
    q = str(tmp_path / "b.bam")
    with open(q, "wb") as f:
        for k in range(0, len(data), 500):
            files.write_bgzf(f, data[k : k + 500], False)
        files.write_bgzf(f, b"", True)
    header = bam.BamHeader(q)
    whole = files.Split(q, 0, files.size_of(q), "bgzf")
    want = [r for d in bam.records(whole, header) for r in bam.decode(d, header.names, False, ["name"], {}).column(0).to_pylist()]
    assert len(want) == 300
    for size in (600, 5000):
        got = [r for s in files.splits([q], size) for d in bam.records(s, header) for r in bam.decode(d, header.names, False, ["name"], {}).column(0).to_pylist()]
        assert got == want


def test_depth(spark, sam):
    df = lf.read_sam(spark, sam)
    import re
    from collections import Counter

    want = Counter()
    for r in df.filter("chrom is not null").collect():
        at = r["start"]
        for n, o in re.findall(r"(\d+)([MDN])|\d+S", r["cigar"]):
            if o == "M":
                want.update((r["chrom"], p) for p in range(at, at + int(n)))
            at += int(n or 0)
    blocks = lf.depth(df).collect()
    got = Counter({(b["contig"], p): b["coverage"] for b in blocks for p in range(b["pos_start"], b["pos_end"] + 1)})
    assert got == want
    zero = lf.depth(df, zero_based=True).agg(F.sum(F.col("pos_end") - F.col("pos_start")).alias("n")).first()["n"]
    assert zero == len(want)
    per = lf.depth(df, per_base=True)
    assert per.count() == 150000 and per.agg(F.sum("coverage")).first()[0] == sum(want.values())


def test_sql(spark, sam, tmp_path):
    assert lf.register_sam(spark, sam) == "a"
    assert lf.sql(spark, "select count(*) as n from a").first()["n"] == 300
    assert lf.sql(spark, f"select sum(coverage) as c from depth('{sam}') d where contig = 'c1'").first()["c"] > 0
    lf.with_coordinate_system(spark.createDataFrame([("A", 1, 5)], "chrom string, start long, end long"), True).createOrReplaceTempView("iv")
    assert lf.sql(spark, "select count from count_overlaps(iv, iv)").first()["count"] == 1
    assert lf.sql(spark, "select 'from depth(x)' as s, coverage from coverage(iv, iv)").first()["coverage"] == 4
    lf.register_view(spark, "v2", "select chrom from iv")
    assert spark.table("v2").count() == 1 and lf.deregister_table(spark, "v2")
    with pytest.raises(Exception):
        lf.register_vcf(spark, str(tmp_path / "none.vcf"), "iv")
    assert spark.table("iv").count() == 1


def index_of(path, csi):
    """A tabix or CSI index of a BGZF file of chrom and 1-based position in the first two columns, one chunk a line."""
    import gzip
    import struct

    from locusflow.sources.files import blocks

    places, held, line_at = [], b"", 0
    with open(path, "rb") as f:
        for at, data in blocks(f, 0):
            for k in range(len(data)):
                if not held:
                    line_at = at << 16 | k
                held += data[k : k + 1]
                if held.endswith(b"\n"):
                    places.append((held, line_at))
                    held = b""
    ends = [p for _, p in places[1:]] + [1 << 47]
    shift, depth = (14, 6) if csi else (14, 5)
    refs = {}
    for (line, a), b in zip(places, ends):
        if line.startswith(b"#"):
            continue
        chrom, pos = line.split(b"\t")[:2]
        lo = int(pos) - 1
        number = ((1 << 3 * depth) - 1) // 7 + (lo >> shift)
        refs.setdefault(chrom, {}).setdefault(number, []).append((a, b, lo >> shift))
    names = b"".join(c + b"\0" for c in refs)
    head = struct.pack("<7i", 2, 1, 2, 0, 35, 0, len(names)) + names
    out = (b"CSI\1" + struct.pack("<3i", shift, depth, len(head)) + head + struct.pack("<i", len(refs))) if csi else (b"TBI\1" + struct.pack("<i", len(refs)) + head)
    for own in refs.values():
        out += struct.pack("<i", len(own))
        for number, chunks in own.items():
            out += struct.pack("<I", number) + (struct.pack("<Q", chunks[0][0]) if csi else b"") + struct.pack("<i", len(chunks)) + b"".join(struct.pack("<QQ", a, b) for a, b, _ in chunks)
        if not csi:
            most = max(w for c in own.values() for *_, w in c) + 1
            linear = [min((a for c in own.values() for a, _, w in c if w >= k), default=0) for k in range(most)]
            out += struct.pack("<i", most) + struct.pack(f"<{most}Q", *linear)
    with gzip.open(path + (".csi" if csi else ".tbi"), "wb") as f:
        f.write(out)


@pytest.mark.parametrize("csi", [False, True])
def test_regions_by_index(spark, tmp_path, csi):
    from locusflow.sources import tabix

    path = f"{tmp_path}/v.vcf.gz"
    want = [(c, 1 + 977 * k) for c in ("c1", "c2") for k in range(9000)]
    d = lf.with_coordinate_system(spark.createDataFrame([(c, p, p, f"rs{p}", "A", "T") for c, p in want], "chrom string, start long, end long, id string, ref string, alt string").coalesce(1), False)
    lf.write_vcf(d, path)
    for regions in (["c1:1,000,000-1,100,000"], ["c2:5000-6000", "c1:8,000,000"], ["c2"], ["c3"], ["c1:2-3"]):
        inside = sorted((c, p) for c, p in want if any(r.chrom == c and r.start < p <= r.end for r in map(tabix.region, regions)))
        whole = sorted(tuple(r) for r in lf.read_vcf(spark, path, regions=regions).select("chrom", "start").collect())
        assert whole == inside
    index_of(path, csi)
    for regions in (["c1:1,000,000-1,100,000"], ["c2:5000-6000", "c1:8,000,000"], ["c2"], ["c3"], ["c1:2-3"]):
        inside = sorted((c, p) for c, p in want if any(r.chrom == c and r.start < p <= r.end for r in map(tabix.region, regions)))
        assert sorted(tuple(r) for r in lf.read_vcf(spark, path, regions=regions).select("chrom", "start").collect()) == inside
    import os

    read = sum(b - a for a, b in tabix.ranges_of(path, [tabix.region("c2:8,500,000")]))
    assert 0 < read <= min(os.path.getsize(path), (3 << 16))
    with pytest.raises(ValueError):
        tabix.region("c1:9-2")
    assert tabix.region("HLA:x").chrom == "HLA:x"
