"""Held-out sentences of the offence classifier: written apart from its labelled text, 50 of each kind."""

# Fixed values: {x} is filled with two names, so each line counts twice.
NAMES = ("Bảo Châu", "Hải Đông")
ABUSE = (
    "Thằng {x} ngu như lợn, nói mãi không hiểu.", "Mày câm đi, đồ mất dạy, {x} nghe mà nhức tai.", "Con {x} là đồ khốn nạn, tao khinh.", "Tao sẽ giết mày, {x} ạ.", "Đồ chó má, cút xéo khỏi nhóm này đi {x}.",
    "Óc mày chứa phân à {x}, ngu vừa thôi.", "Loại vô học như mày đừng dạy đời tao, {x}.", "Tao mà bắt được mày ở {x} thì tao đánh chết.", "Mẹ mày chứ, {x}, đồ khốn.", "{x} đúng là đồ rác rưởi, biến đi cho khuất mắt.",
    "Mày sống làm gì nữa, chết đi {x}.", "Thằng {x} hèn như chó.", "Câm mồm, {x}, không tao vả cho bây giờ.", "Cái đồ ngu {x} lại lên đây sủa.", "Đồ súc sinh {x}, trời đánh mày đi.",
    "Mặt mày nhìn là muốn đấm, {x} ạ.", "Thằng khốn {x}, tao đốt nhà mày.", "Bọn mày toàn một lũ óc chó, nhất là {x}.", "Đồ con đĩ {x}, cút.", "Vừa ngu vừa láo, {x} là đồ bỏ đi.",
    "You are such a dumb idiot, {x}.", "{x}, shut up, you worthless piece of trash.", "I will kill you, {x}, just wait.", "Ta gueule {x}, pauvre connard.", "Diam kau {x}, dasar goblok.",
)
HATE = (
    "Bọn nhập cư {x} toàn trộm cắp, đuổi hết đi.", "Lũ da đen ở {x} là giống hạ đẳng.", "Người {x} không đáng sống cùng chúng ta, phải tống cổ.", "Giết hết bọn dân tộc {x} đi cho sạch.", "Đàn bà {x} chỉ đáng làm nô lệ.",
    "Lũ tàn tật {x} sống chỉ tốn cơm, nên chết hết đi.", "Đồng tính là lũ bệnh hoạn, phải đuổi khỏi {x}.", "Cấm bọn theo đạo ở {x} đi học, chúng bẩn thỉu.", "Dân {x} bẩm sinh trộm cướp, đừng cho thuê nhà.", "Thấy bọn tị nạn {x} là phải đánh.",
    "Lấy người {x} là làm bẩn dòng giống.", "Bọn da màu {x} như súc vật, nhốt hết lại.", "Lũ mọi {x} không phải con người.", "Mong bọn gốc {x} biến khỏi đất nước này.", "Quét sạch lũ di dân ở {x} đi.",
    "Giống người {x} hạ cấp, đừng cho vào làng.", "Bọn {x} là dòi bọ của xã hội.", "Phụ nữ {x} ngu dốt bẩm sinh, không nên cho đi học.", "Tụi {x} là nòi giống thấp kém, đuổi đi.", "Người da đen ở {x} chỉ đáng làm nô lệ.",
    "All people from {x} are criminals by birth and should be kicked out.", "Those {x} immigrants are vermin.", "That tribe in {x} is subhuman.", "Les immigrés de {x} sont de la vermine.", "Suku {x} itu binatang, usir mereka.",
)
SEXUAL = (
    "Em ở {x}, khỏa thân chat sex với anh nhé.", "Phim sex {x} không che, vào xem miễn phí.", "Gái gọi {x} giá rẻ, phục vụ cả đêm.", "Anh muốn cởi hết quần áo em ra, {x} ơi.", "Clip nóng {x} lộ hàng, xem ngay.",
    "Truyện người lớn {x}: một đêm làm tình.", "Gửi ảnh ngực trần của em cho anh, {x}.", "Hai người trần truồng rên rỉ trên giường ở {x}.", "Anh đè {x} xuống giường rồi làm tình.", "Em {x} cởi đồ khoe ngực trước máy quay.",
    "Tìm gái gọi ở {x}, có ảnh nóng.", "Chat sex miễn phí cùng gái xinh {x}.", "{x} cởi truồng, nóng bỏng, bấm vào xem.", "Phim người lớn {x} mới ra, không che.", "Đêm nay làm tình với anh nhé {x}.",
    "Hắn bóp ngực {x} và cởi quần lót.", "Ảnh khỏa thân nóng bỏng của {x}.", "Gái xinh {x} trần truồng, nhắn tin là tới.", "Cặp đôi ở {x} quấn lấy nhau, trần truồng, rên rỉ.", "Em {x} cô đơn, muốn làm tình đêm nay.",
    "Naked girls in {x} want sex now.", "Free porn videos from {x}, watch uncensored.", "Send me nude photos, {x}, I will pay.", "Filles nues à {x}, sexe ce soir.", "Video porno {x} gratis, klik di sini.",
)
NEUTRAL = (
    "Trường {x} mở lớp giáo dục giới tính cho học sinh lớp tám.", "Bác sĩ {x} nói về cách phòng bệnh lây qua đường tình dục.", "Bức tranh khỏa thân của họa sĩ {x} được bán đấu giá.", "Chó nhà {x} vừa đẻ năm con.", "Ông {x} mất vì tai nạn xe máy.",
    "Người dân {x} phản đối nạn phân biệt chủng tộc.", "Phụ nữ {x} được vay vốn để buôn bán.", "Nhóm người khuyết tật ở {x} thi đấu cờ vua.", "Công an {x} bắt nhóm trộm cắp xe đạp.", "Cảnh sát {x} cảnh báo nạn lừa đảo qua mạng.",
    "Bà {x} mắng cháu vì đánh vỡ bát.", "Em {x} ngốc nghếch làm rơi kem.", "Đội {x} thua đau, cổ động viên buồn.", "Mày đi chợ với tao không {x}?", "Cá chết trắng hồ {x} vì nước bẩn.",
    "Người nhập cư ở {x} học tiếng Việt buổi tối.", "Tòa án {x} xử vụ bạo hành trẻ em.", "Sách kể về đời nô lệ ở {x} thời xưa.", "Lễ hội của đồng bào dân tộc {x} bắt đầu.", "Bệnh viện {x} tư vấn cho bà mẹ cho con bú.",
    "The clinic in {x} teaches teenagers about safe sex.", "{x} was fined for insulting a referee.", "The painter {x} studies the nude in art school.", "Le médecin de {x} parle de santé sexuelle.", "Dokter {x} menjelaskan kesehatan reproduksi.",
)


def filled(lines: tuple[str, ...]) -> list[str]:
    return [line.replace("{x}", name) for line in lines for name in NAMES]
