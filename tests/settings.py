"""What test modules share besides fixtures."""

SF_DIR = "/root/testdata/sf0.001"
