"""Reports as tools write them: other names and cases of columns, thousands' commas, files of another kind."""

from cohortlens.sources import readers


def put(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "SAMPLE1_1_bismark_bt2_PE_report.txt").write_text(content)
    return str(tmp_path / "runs")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_bismark(spark, tmp_path):
    at = put(
        tmp_path, a="Sequences analysed in total:\t1000\nMapping Efficiency:\t78.90 %\n", b="Total number duplicated alignments removed:\t97,335 (12.34%)\n", c="Bisulfite conversion rate: 99.10%\n",
        d="Post conversion: 50%\nC methylated in CpG context:\t71.2%\n", e="mapping efficiency:\tn/a\n", f="Conversion Rate:\t98%",
    )
    assert rows(readers.bismark(spark, at), "run_id", "sample", "metric", "value") == [("a", "SAMPLE1", "percent_aligned", 78.9), ("b", "SAMPLE1", "percent_duplication", 12.34), ("c", "SAMPLE1", "percent_bs_conversion", 99.1), ("f", "SAMPLE1", "percent_bs_conversion", 98.0)]


def test_dada2(spark, tmp_path):
    at = put(tmp_path, a="sample_id\treads_input\tnon_chim\nx\t100\t40\ny\t0\t0\nz\tbad\t3\n", b="Sample\tDADA2_input\tDADA2_nonchim\nx\t10\t5\n", c="name\tInput\tNonchimeric\nq\t8\t2\n", d="sample\tother\nx\t1\n", e="INDEX\tinput\nw\t9\n\t5\n")
    assert rows(readers.dada2(spark, at), "run_id", "sample", "input_reads", "percent_retained") == [("a", "x", 100.0, 40.0), ("a", "y", 0.0, None), ("a", "z", None, None), ("b", "x", 10.0, 50.0), ("c", "q", 8.0, 25.0), ("e", "w", 9.0, None)]


def test_asv(spark, tmp_path):
    at = put(tmp_path, a="ASV\tS1\tS2\tid\tTaxonomy\tsequence\nq1\t5\t0\t1\tx\tAC\nq2\t0\t0\t2\ty\tGT\n", b="7\tS1\tnote\n1\t3\tx\n2\t4\t5\n", c="S0\tS1\tS2\nq\t1\t2\nr\t1\n", d="ASV_ID\tS1\n")
    assert rows(readers.asv_counts(spark, at), "run_id", "sample", "asv_count") == [("a", "S1", 1), ("a", "S2", 0), ("b", "S1", 2), ("c", "S1", 2)]


def test_quast_and_checkm(spark, tmp_path):
    at = put(tmp_path, a="Bin\tN50\nb1\t5000\nb2\t-\n", b="name\tn50\nfirst\t7\n", c="Assembly\tL50\nb\t3\n", d="N50\tASSEMBLY\n9\tb9\n")
    assert rows(readers.quast(spark, at), "run_id", "bin", "n50") == [("a", "b1", 5000.0), ("a", "b2", None), ("b", "first", 7.0), ("d", "b9", 9.0)]
    at = put(tmp_path / "m", a="bin_id\tCOMPLETENESS\tcontamination\nb1\t98.5\t1.2\n", b="what\tCompleteness\nfirst\tx\n", c="Bin Id\tMarker lineage\nb\tk\n")
    assert rows(readers.checkm(spark, at), "run_id", "bin", "completeness", "contamination") == [("a", "b1", 98.5, 1.2), ("b", "first", None, None)]
