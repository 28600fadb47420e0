"""quillspark.sources"""
