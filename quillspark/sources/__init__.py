"""Sources and sinks: files, pages, descriptors, subtitles and office documents to DataFrames, and back."""
