"""contractlake: Spark jobs for contract evolution and recorded wire traffic."""
