"""Driver-side rendering of small results: CSV, Markdown, HTML, SVG and PNG."""
