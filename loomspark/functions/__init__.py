"""Column functions: URLs, text, quality, and the HTML functions behind Arrow UDFs."""
