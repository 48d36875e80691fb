"""Reading and writing: corpus files, stages and tokenizers."""
