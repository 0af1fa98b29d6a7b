"""``DataFrame -> DataFrame`` operators over panels and entity tables."""
