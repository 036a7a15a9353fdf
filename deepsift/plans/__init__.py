"""Views that shape general tables like sequencing data, and the registered queries over them."""
