"""The public names in one place."""

from .core import (
    CoordinateSystemMismatchError, FilterOp, MissingCoordinateSystemError, coordinate_system, get_metadata, get_option, print_metadata_json, print_metadata_summary, set_loglevel, set_option, set_source_metadata, with_coordinate_system,
)
from .fluent import Intervals, intervals
from .functions.depth import depth
from .functions.fastqc import FastQCResult, fastqc
from .operators.interval import cluster, complement, count_overlaps, coverage, expand, merge, nearest, overlap, sort, subtract
from .plotting import visualize_intervals
from .sources.bam import describe_bam, read_bam, sink_bam, write_bam
from .sources.bbi import read_bigbed, read_bigwig
from .sources.bcf import describe_bcf, read_bcf
from .sources.bgen import describe_bgen, read_bgen, read_bgen_matrix
from .sources.fastq import read_fastq
from .sources.sinks import sink_fasta, sink_fastq, sink_sam, sink_vcf, write_fasta, write_fastq, write_sam, write_vcf
from .sources.inputs import read_any
from .sources.text import attribute, describe_sam, describe_vcf, read_bed, read_fasta, read_gff, read_gtf, read_pairs, read_sam, read_table, read_vcf, with_attributes
from .sql import deregister_table, register, register_bam, register_bcf, register_bed, register_bgen, register_bigbed, register_bigwig, register_fasta, register_fastq, register_gff, register_gtf, register_pairs, register_sam, register_vcf, register_view, sql
from .streaming.overlap import overlap_stream

# every Spark read is lazy: scanning is reading
scan_bam, scan_bcf, scan_bed, scan_bgen, scan_bigbed, scan_bigwig, scan_fasta, scan_fastq, scan_gff, scan_gtf, scan_pairs, scan_sam, scan_table, scan_vcf = read_bam, read_bcf, read_bed, read_bgen, read_bigbed, read_bigwig, read_fasta, read_fastq, read_gff, read_gtf, read_pairs, read_sam, read_table, read_vcf
