"""The assembled checks of runs whose files are missing, empty or ambiguous."""

from cohortlens.operators import assembly

CALL = "run_id string, path string, chrom string, pos long, ref string, alt string, gt string, ann string, idx int, vaf_tumor double, vaf_normal double, vaf_strelka double, line int"
HEAD = "run_id string, path string, annotated boolean, pon string, build string, tumor string, normal string"


def checks(spark, assay, heads, records, metrics=(), located=(), files=()):
    df = lambda rows, s: spark.createDataFrame(list(rows), s)
    out = assembly.all_checks(
        spark, df([("r", assay), ("r", assay)], "run_id string, assay string"), df(metrics, "run_id string, family string, sample string, metric string, value double"), df(located, "run_id string, family string, sample string"),
        df(files, "run_id string, path string, size long"), df(heads, HEAD), df(records, CALL), ["line"],
    )
    rows = out.collect()
    assert len({r.check for r in rows}) == len(rows)
    return {r.check: (r.status, r.value, r.informational) for r in rows}


def test_germline_without_records(spark):
    got = checks(spark, "variant_calling", [("r", "x/b.vcf.gz", True, None, None, None, None), ("r", "x/a.vcf.gz", False, None, None, None, None)], [])
    assert got == {
        "ts_tv_ratio:sample": ("unverified", None, False), "het_hom_ratio:sample": ("unverified", None, False), "variant_count:sample": ("fail", 0.0, False), "sex_plausibility": ("unverified", None, False), "x_het_ratio": ("unverified", None, True),
        "annotation_present": ("pass", None, False), "annotation_complete": ("unverified", None, False), "annotation_real_fraction:sample": ("unverified", None, False), "annotation_consequence_distribution:sample": ("unverified", None, False),
    }


def test_last_line_of_a_site_counts_in_the_first_file_only(spark):
    rec = lambda path, pos, gt, line, ann="": ("r", path, "1", pos, "A", "G", gt, ann, 1, None, None, None, line)
    got = checks(spark, "variant_calling", [("r", "a.vcf.gz", False, None, None, None, None), ("r", "b.vcf.gz", True, None, None, None, None)], [rec("a.vcf.gz", 1, "0/1", 1), rec("a.vcf.gz", 1, "1/1", 2), rec("a.vcf.gz", 2, "0/1", 3), rec("b.vcf.gz", 3, "0/1", 1, "A|intergenic_variant|"), rec("b.vcf.gz", 4, "0/1", 2)])
    assert got["het_hom_ratio:sample"] == ("warn", 1.0, False) and got["variant_count:sample"] == ("warn", 2.0, False)
    assert got["annotation_complete"] == ("warn", 0.5, False) and got["annotation_consequence_distribution:sample"] == ("warn", 1.0, False)


def test_somatic_layouts(spark):
    head = lambda path: ("r", path, False, "pass", None, "T", "N")
    rec = lambda path, alt, v, line: ("r", path, "1", line, "A", alt, None, None, None, v, v / 4, v / 2, line)
    got = checks(spark, "somatic_variant_calling", [head("o/Mutect2/p1/x.vcf.gz"), head("o/strelka/p1/somatic_snvs.vcf.gz"), head("o/strelka/p1/somatic_indels.vcf.gz"), head("o/strelka/p1/z.snvs.vcf.gz")],
                 [rec("o/Mutect2/p1/x.vcf.gz", "G", 0.2, 1), rec("o/Mutect2/p1/x.vcf.gz", "G", 0.4, 2), rec("o/Mutect2/p1/x.vcf.gz", "G,T", 0.9, 3), rec("o/strelka/p1/somatic_snvs.vcf.gz", "G", 0.4, 1), rec("o/strelka/p1/somatic_indels.vcf.gz", "GT", 0.8, 1), rec("o/strelka/p1/z.snvs.vcf.gz", "G", 0.0, 1)])
    assert {k: (s, None if v is None else round(v, 9)) for k, (s, v, _) in got.items()} == {
        "median_vaf:T": ("pass", 0.3), "somatic_variant_count:T": ("warn", 2.0), "normal_median_vaf:N": ("pass", 0.075), "strelka_median_vaf:TUMOR": ("pass", 0.3), "pon_applied": ("pass", None),
    }
    got = checks(spark, "somatic_variant_calling", [head("o/strelka/p1/snv.vcf.gz"), head("o/strelka/p2/indel.vcf.gz")], [])
    assert got == {"somatic_vaf_plausibility": ("unverified", None, False), "strelka_median_vaf": ("unverified", None, False)}
    assert checks(spark, "somatic_variant_calling", [head("o/x.vcf")], []) == {}


def test_reports_files_and_other_assays(spark):
    got = checks(spark, "mag", [("r", "a.vcf.gz", True, None, None, None, None)], [], [("r", "mag", "bin1", "completeness", 80.0), ("r", "multiqc", "s", "completeness", 1.0)], [("r", "mag", "bin1"), ("r", "mag", "bin2")], [("r", "o/x.bam", 0), ("r", "o/y.bam", 7), ("r", "o/y.bam.bai", 0), ("other", "o/z.bam", 0)])
    assert got == {"bin_completeness:bin1": ("pass", 80.0, False), "mag_qc:bin2": ("unverified", None, False), "output_present:x.bam": ("fail", 0.0, False), "output_present:y.bam": ("pass", 7.0, False)}
    got = checks(spark, "rnaseq", [], [], [("r", "multiqc", "s", "percent_assigned", 50.0), ("r", "multiqc", "s", "PERCENT_DUPLICATION", 12.0)])
    assert got == {"assignment_rate:s": ("warn", 50.0, False), "rrna_contamination:s": ("unverified", None, False), "duplication_rate:s": ("unverified", 12.0, True), "min_sample_count": ("fail", 1.0, False)}
    assert checks(spark, "unknown", [("r", "a.vcf.gz", True, None, None, None, None)], [], [("r", "multiqc", "s", "percent_assigned", 50.0)]) == {}
