"""The given tables' folders, by scale."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
SF_BENCH = "/root/testdata/sf0.1"
