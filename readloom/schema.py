"""Canonical schemas."""

# Reads: quals is Phred + 33 text, raw_quals the text as submitted.
RAW_READS = "file string, file_no int, read_no bigint, name string, bases string, plus string, raw_quals string, error string, line_no bigint"
SAM = "file string, record_no bigint, qname string, flags int, rname string, pos int, mapq string, cigar string, rnext string, pnext int, tlen int, bases string, quals string, tags map<string,string>"
SAM_HEADER = "file string, line_no bigint, record string, tags map<string,string>"
