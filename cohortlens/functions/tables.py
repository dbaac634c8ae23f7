"""Rule packs, ranks, needles and vocabularies as plain data."""

from __future__ import annotations

SEVERITY_OF = {"fail": 3, "warn": 2, "pass": 1, "unverified": 0}
# Fixed values.
CLAIM_EPSILON = 1e-9
# Fixed values.
MIN_SHARED = {"spearman": 10, "genotype": 1, "somatic": 10, "consequence": 10}

#: pack, check, metric, fail below, warn below, warn above, fail above, unit. Fixed values.
RULES = [
    ("rnaseq", "alignment_rate", "uniquely_mapped_percent", 40.0, 60.0, None, None, None),
    ("rnaseq", "assignment_rate", "percent_assigned", 40.0, 60.0, None, None, None),
    ("rnaseq", "salmon_mapping_rate", "percent_mapped", 40.0, 60.0, None, None, None),
    ("variant_calling", "ts_tv_ratio", "ts_tv", 1.2, 1.8, 2.4, 3.6, None),
    ("variant_calling", "het_hom_ratio", "het_hom", 1.0, 1.4, 2.5, 3.0, None),
    ("variant_calling", "variant_count", "variant_count", 1.0, 10.0, 20000000.0, None, None),
    ("variant_calling", "mean_coverage", "mean_coverage", 10.0, 20.0, None, None, None),
    ("scrnaseq", "estimated_cells", "estimated_cells", 100.0, 500.0, None, None, None),
    ("scrnaseq", "median_genes_per_cell", "median_genes_per_cell", 200.0, 500.0, None, None, None),
    ("scrnaseq", "fraction_reads_in_cells", "fraction_reads_in_cells", 0.5, 0.7, None, None, None),
    ("methylseq", "bisulfite_conversion", "percent_bs_conversion", 95.0, 98.0, None, None, None),
    ("methylseq", "mapping_efficiency", "percent_aligned", 30.0, 50.0, None, None, None),
    ("methylseq", "duplication_rate", "percent_duplication", None, None, 50.0, 75.0, None),
    ("ampliseq", "dada2_read_retention", "percent_retained", 20.0, 50.0, None, None, None),
    ("ampliseq", "asv_count", "asv_count", 10.0, 50.0, None, None, None),
    ("ampliseq", "sample_read_depth", "input_reads", 1000.0, 10000.0, None, None, None),
    ("mag", "assembly_n50", "n50", 1000.0, 5000.0, None, None, None),
    ("mag", "bin_completeness", "completeness", 50.0, 70.0, None, None, None),
    ("mag", "bin_contamination", "contamination", None, None, 5.0, 10.0, None),
    ("rnaseq_plausibility", "duplication_rate", "PERCENT_DUPLICATION", None, None, None, None, "fraction"),
    ("rnaseq_plausibility", "rrna_contamination", "percent_rRNA", None, None, 10.0, None, None),
    ("somatic_plausibility", "median_vaf", "median_vaf", None, 0.05, 0.95, None, None),
    ("somatic_plausibility", "strelka_median_vaf", "strelka_median_vaf", None, 0.05, 0.95, None, None),
    ("somatic_plausibility", "somatic_variant_count", "somatic_variant_count", 1.0, 10.0, 100000.0, None, None),
    ("somatic_plausibility", "normal_median_vaf", "normal_median_vaf", None, None, 0.30, None, None),
    ("annotation_plausibility", "annotation_real_fraction", "real_consequence_fraction", None, 0.10, None, None, None),
    ("annotation_plausibility", "annotation_consequence_distribution", "intergenic_fraction", None, None, 0.95, None, None),
    ("rnaseq_composition", "exonic_fraction", "exonic_fraction", None, 0.50, None, None, None),
    ("rnaseq_composition", "intronic_fraction", "intronic_fraction", None, None, 0.30, None, None),
    ("rnaseq_composition", "unassigned_fraction", "unassigned_fraction", None, None, 0.30, None, None),
]
RULE_SCHEMA = "pack string, ord int, check string, metric string, fail_below double, warn_below double, warn_above double, fail_above double, unit string"

#: Consequence terms from least to most severe. Terms are lower-cased before they are looked up, so the two UTR names never match. Fixed values.
SEVERITY = [
    "intergenic_variant", "downstream_gene_variant", "upstream_gene_variant", "intron_variant", "non_coding_transcript_exon_variant",
    "non_coding_transcript_variant", "3_prime_UTR_variant", "5_prime_UTR_variant", "synonymous_variant", "stop_retained_variant",
    "start_retained_variant", "splice_region_variant", "protein_altering_variant", "inframe_deletion", "inframe_insertion", "missense_variant",
    "start_lost", "stop_lost", "frameshift_variant", "stop_gained", "splice_donor_variant", "splice_acceptor_variant", "transcript_ablation",
]

#: build, chromosome, first and last position, inclusive. Fixed values.
PAR = [
    ("GRCh37", "X", 60001, 2699520), ("GRCh37", "X", 154931044, 155260560), ("GRCh37", "Y", 10001, 2649520), ("GRCh37", "Y", 59034050, 59373566),
    ("GRCh38", "X", 10001, 2781479), ("GRCh38", "X", 155701383, 156030895), ("GRCh38", "Y", 10001, 2781479), ("GRCh38", "Y", 56887903, 57217415),
]
CHRX_LENGTH = {"155270560": "GRCh37", "156040895": "GRCh38"}

# Fixed values.
SALIENT = ["error", "fail", "killed", "not found", "exit", "out of memory", "cannot", "unable", "no such", "missing", "denied", "fault", "exception", "traceback"]

#: class, confidence, groups of needles: a rule fires if some line holds one needle of each group. In order; the first that fires wins. Fixed values.
_INDEX = ["index file", ".fai", ".bai", ".tbi", ".csi"]
FAILURES = [
    ("no_progress", 0.9, [["no forward progress", "no new output or trace update", "terminating the stalled run"]]),
    ("oom", 0.9, [["out of memory", "outofmemoryerror", "killed", "oom"]]),
    ("time_limit", 0.9, [["due to time limit", "term_runlimit", "time limit"]]),
    ("disk_full", 0.9, [["no space left on device", "enospc", "disk quota exceeded"]]),
    ("permission_denied", 0.85, [["permission denied", "eacces"]]),
    ("container_unavailable", 0.9, [["docker desktop is unable to start", "cannot connect to the docker daemon", "docker.sock"]]),
    ("container_pull_failed", 0.9, [["failed to pull", "manifest unknown", "pull access denied", "error response from daemon: pull"]]),
    ("download_failed", 0.85, [["failed to download", "unable to stage", "error staging", "connection timed out", "connection reset by peer", "temporary failure in name resolution"]]),
    ("conda_solve_failed", 0.9, [["resolvepackagenotfound", "packagesnotfounderror"]]),
    ("missing_index", 0.85, [["older than"], _INDEX]),
    ("missing_index", 0.85, [["not found", "missing", "no such file"], ["index", ".fai", ".bai", ".tbi", ".csi"]]),
    ("missing_index", 0.85, [["does not exist", "not found", "no such file", "missing"], [".dict"]]),
    ("missing_index", 0.85, [["genomeparameters.txt", "could not open genome file"]]),
    ("missing_index", 0.85, [["genome version"], ["incompatible"]]),
    ("missing_index", 0.85, [["bwa_idx_load_from_disk"], ["fail to locate the index"]]),
    ("missing_index", 0.85, [["unable to open the file"], ["bwt.2bit.64"]]),
    ("missing_reference", 0.85, [["no such file or directory"], [".fasta", ".fa", ".gtf", ".gff", "reference", "genome"]]),
    ("bad_param", 0.85, [["unknown option", "unrecognized arguments", "unexpected argument", "is not a valid parameter", "validation of pipeline parameters failed", "invalid input values have been detected", "schemavalidationexception"]]),
    ("platform_unsupported", 0.7, [["does not match the detected host platform", "requested image's platform", "no matching manifest for"]]),
    ("reference_not_bgzf", 0.85, [["cannot index files compressed with gzip"]]),
    ("alignment_format_mismatch", 0.85, [["cram_decode_slice", "for cram decoding", "required for cram"]]),
]

#: class, kind, operation, risk. Fixed values.
REPAIRS = [
    ("oom", "resource", "memory_x2", "safe"), ("time_limit", "resource", "time_x2", "safe"), ("container_pull_failed", "retry", "retry", "safe"),
    ("download_failed", "retry", "retry", "safe"), ("no_progress", "retry", "retry", "safe"), ("container_unavailable", "retry", "retry_after_15s", "safe"),
    ("missing_index", "reference", "build_index", "needs_confirmation"), ("reference_not_bgzf", "reference", "recompress", "needs_confirmation"),
    ("missing_reference", "parameter", "igenomes_ignore", "needs_confirmation"), ("bad_param", "parameter", "validate_params_off", "needs_confirmation"),
    ("platform_unsupported", "advice", "advise", "advisory"), ("conda_solve_failed", "advice", "advise", "advisory"),
    ("disk_full", "advice", "advise", "advisory"), ("permission_denied", "advice", "advise", "advisory"),
]

#: assay, phrases; in order, the first phrase that occurs wins. Fixed values.
ASSAYS = [
    ("scrnaseq", ["single cell", "single-cell", "scrna-seq", "scrnaseq", "scrna", "10x"]),
    ("rnaseq", ["rna-seq", "rnaseq", "rna seq", "differential expression", "differentially express", "gene expression", "transcript", "deg"]),
    ("somatic_variant_calling", ["somatic", "tumor", "tumour", "tumor-normal", "tumor normal", "tumour-normal"]),
    ("variant_calling", ["variant calling", "germline variant", "call variants", "snp", "snv", "indel", "variant caller"]),
    ("methylseq", ["methylation", "methyl-seq", "methylseq", "bisulfite", "wgbs"]),
    ("mag", ["metagenom", "shotgun", " mag", "mags"]),
    ("ampliseq", ["16s", "amplicon", "microbiome", "dada2"]),
]
# Fixed values.
PIPELINES = [
    ("rnaseq", "nf-core/rnaseq"), ("scrnaseq", "nf-core/scrnaseq"), ("variant_calling", "nf-core/sarek"), ("somatic_variant_calling", "nf-core/sarek"),
    ("methylseq", "nf-core/methylseq"), ("mag", "nf-core/mag"), ("ampliseq", "nf-core/ampliseq"),
]

# Fixed values.
METRIC_WORDS = [
    "auc", "auroc", "auprc", "area under the curve", "accuracy", "precision", "recall", "f1", "f1 score", "f-score", "sensitivity", "specificity", "pearson",
    "spearman", "correlation", "r2", "r²", "r-squared", "mse", "rmse", "mae", "dice", "iou", "fold change", "log2 fold change", "log fold change",
]
CONNECTIVES = ["of", "was", "is", "reached", "achieved", "at", "=", ":"]
INEQUALITIES = ["<=", ">=", "<", ">", "≤", "≥"]

#: assay, glob, role. Fixed values.
MANIFESTS = [
    ("rnaseq", "*.bam", "required"), ("rnaseq", "*salmon.merged.gene_counts*", "required"), ("rnaseq", "*.cram", "optional"),
    ("variant_calling", "*.vcf.gz", "required"), ("somatic_variant_calling", "*.vcf.gz", "required"),
    ("scrnaseq", "*.h5ad", "required"), ("scrnaseq", "*matrix.mtx*", "required"), ("methylseq", "*.bam", "required"), ("methylseq", "*.bedGraph.gz", "required"),
    ("ampliseq", "*ASV_table*", "required"), ("ampliseq", "*.fasta*", "required"), ("mag", "*.fa*", "required"),
]
